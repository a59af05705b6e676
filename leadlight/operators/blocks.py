"""Rows that meet all others of their key, however many a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlight.sources.storage import stored

#: Crowded keys that may be broadcast; beyond that they are joined by shuffle, where Spark splits what is skewed.
BROADCAST = 100_000
#: Tasks for each core that all pairs of a table are dealt out over.
TASKS = 8


def dealt(rows: DataFrame, keys: list[str], ident: Column, crowd: int) -> DataFrame:
    """The rows with i, j and chunk: any two rows of a key meet at exactly one (key, i, j), in chunk i or j each.

    A key with up to ``crowd`` rows has one meeting, (0, 0). Beyond that its rows are cut into chunks by the hash of ``ident``, and
    a row goes to one meeting with each chunk; only crowded keys are repeated at all. ``rows`` are read twice.
    """
    crowded = rows.groupBy(keys).agg(F.ceil(F.count("*") / crowd).cast("int").alias("__n")).where("__n > 1")
    crowded = F.broadcast(crowded) if crowded.limit(BROADCAST + 1).count() <= BROADCAST else crowded.hint("merge")
    return _spread(rows.join(crowded, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(1))), ident)


def _spread(rows: DataFrame, ident: Column) -> DataFrame:
    """The rows at all meetings of their chunk, of which there are ``__n``."""
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64(ident), "__n").cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return cut.withColumns({"i": F.least("chunk", "__o"), "j": F.greatest("chunk", "__o")}).drop("__n", "__o")


def pairs_within(rows: DataFrame, keys: list[str], ident: str, crowd: int) -> DataFrame:
    """Every two rows of a key once, as a_<column> and b_<column>, the smaller ``ident`` first."""
    return _met(dealt(rows, keys, F.col(ident), crowd), keys, ident)


def all_pairs(rows: DataFrame, ident: str, crowd: int) -> DataFrame:
    """Every two rows of a table once, likewise; a task holds two chunks of about ``crowd`` rows.

    Meetings are dealt out over TASKS tasks for each core: few bytes make many pairs, so their size doesn't tell how many tasks they take.
    """
    return _met(blocked(rows, ident, crowd).repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, "i", "j"), [], ident)


def blocked(rows: DataFrame, ident: str, crowd: int) -> DataFrame:
    """The rows at all meetings (i, j) of their chunk with others, of the whole table; a chunk has about ``crowd`` rows."""
    chunks = max(1, -(-rows.count() // crowd))
    return _spread(rows.withColumn("__n", F.lit(chunks)), F.col(ident))


def _met(placed: DataFrame, keys: list[str], ident: str) -> DataFrame:
    meet = [*keys, "i", "j"]
    side = lambda p: placed.select(*meet, *[F.col(c).alias(f"{p}_{c}") for c in placed.columns if c not in meet])
    low = F.col(f"a_{ident}") < F.col(f"b_{ident}")
    # in a meeting of two chunks a pair is of one and the other, whichever has the smaller row
    return side("a").join(side("b"), meet).where(low & ((F.col("i") == F.col("j")) | (F.col("a_chunk") != F.col("b_chunk")))).drop("i", "j", "a_chunk", "b_chunk")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table that has few rows for each key: broadcast up to BROADCAST rows, which are counted.

    A larger table is written first, so that both sides are plain when they are shuffled and Spark splits a key that many rows have.
    """
    small = stored(table, "lookup")
    if small.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(small), keys, how)
    return rows.join(small.hint("merge"), keys, how)
