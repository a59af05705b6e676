"""Operators over compound tables: picklists, summaries, similarity, clusters, features, validation."""
