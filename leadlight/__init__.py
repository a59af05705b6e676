"""Spark-native analytics over compound property tables."""
