"""Training-data operators: tokenizing, media columns, search, packing, scans, scoring, dedup, classifiers.

Every module has a general operator; ``queries.py`` derives the registered queries from them.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
