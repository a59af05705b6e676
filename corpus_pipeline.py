"""From raw documents to packed training sequences: quality, language, near duplicates, packing.

Every stage works on all rows that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlight.llm import langid, neardup, packing, quality
from leadlight.llm.common import in_fold, materialize, table
from leadlight.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ranking learned from ``labels`` puts below its threshold."""
    ranking = quality.train(docs, table(spark, sf_dir, "labels").where(~in_fold("doc_id", 4, 2)))
    return quality.accepted(docs, ranking)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or in no language that the network learned from the rows at hand."""
    return langid.accepted(docs, langid.train(docs.where(~in_fold("doc_id", 4, 2))))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    return neardup.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence of at most 2048 tokens and their offset in it."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_copy),
    ("packing", pack_sequences),
]

#: SQL can express neither of the learned stages nor the sampling; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
