"""A stored index of fingerprints for searches by many queries.

The library is sorted by number of set bits, then by its words, and cut into blocks. Each block keeps its least number of bits, the
bits that any of its rows has and those that all have. From these follows the highest similarity that a query can have with a
row of the block, for every metric: of two sets of a and b bits with c in common all metrics grow with c and fall with b.
A query first visits the blocks with its highest bounds; the others only where their bound reaches its k-th best similarity.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.functions.similarity import bits, metric, words
from leadlight.operators.medoids import Bits
from leadlight.sources.storage import folder, stored

#: Rows of a block, blocks that a query visits first, queries that meet a block in one task.
BLOCK, FIRST, QUERIES = 1024, 2, 1024
#: Words of all blocks' facts that may be broadcast; blocks that are read by name, so that Parquet leaves the others out.
BROADCAST, NAMED = 1 << 20, 1000
HIT = ("a_row", "b_row", "b_id", "b_smiles", "similarity")


@dataclass
class FingerprintIndex:
    """Rows (block, row, Compound_ID, SMILES, fp, bits) and blocks (block, n, least, any, all) below ``path``."""

    spark: SparkSession
    path: str
    n_bits: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def plan(self, queries: DataFrame, name: str, threshold: float | None = None) -> DataFrame:
        """(a_row, a_fp, a_bits, block, bound, place) of every query and block that can reach ``threshold``; place 1 has the highest bound."""
        facts, n_words = self.blocks, -(-self.n_bits // 64)
        asked = queries.where("fp is not null").select(F.col("row").alias("a_row"), F.col("fp").alias("a_fp"), bits(words(F.col("fp"), self.n_bits)).alias("a_bits"))
        facts = F.broadcast(facts) if facts.count() * 2 * n_words <= BROADCAST else facts
        count = lambda f: reduce(add, [F.bit_count(f(F.col("a_fp")[w], w)) for w in range(n_words)])
        common = count(lambda q, w: q.bitwiseAND(F.col("any")[w]))
        beside = count(lambda q, w: F.col("all")[w].bitwiseAND(F.bitwise_not(q)))
        met = asked.join(facts.select("block", "least", "any", "all")).withColumns({"common": common, "beside": beside})
        bound = metric(name)(F.col("a_bits"), F.greatest("least", F.col("common") + F.col("beside")), F.col("common"), self.n_bits) + 1e-9
        able = met.withColumn("bound", bound).select("a_row", "a_fp", "a_bits", "block", "bound")
        able = able if threshold is None else able.where(F.col("bound") >= threshold)
        return able.withColumn("place", F.row_number().over(W.partitionBy("a_row").orderBy(F.desc("bound"), "block")))

    def scored(self, wanted: DataFrame, n_queries: int, name: str, top: int) -> DataFrame:
        """(a_row, b_row, b_id, b_smiles, similarity): of every query and each of its blocks the ``top`` best rows, from its ``floor`` on.

        Queries that have an ``a_smiles`` leave rows with that text out. A task scores up to about QUERIES queries with one block.
        """
        salts = max(1, -(-n_queries // QUERIES))
        asked = wanted.withColumn("salt", F.pmod(F.xxhash64("a_row"), F.lit(salts)).cast("int"))
        needed = stored(asked.select("block", "salt").distinct(), "needed")
        names = [r["block"] for r in needed.select("block").distinct().limit(NAMED + 1).collect()]
        rows = self.rows.where(F.col("block").isin(names)) if len(names) <= NAMED else self.rows
        there = rows.select("block", F.col("row").alias("b_row"), F.col("Compound_ID").alias("b_id"), F.col("SMILES").alias("b_smiles"), F.col("fp").alias("b_fp")).join(needed, "block")
        measure, excluding = Bits(name, self.n_bits), "a_smiles" in wanted.columns

        def run(queries: pa.Table, block: pa.Table) -> pa.Table:
            if not queries.num_rows or not block.num_rows:
                return pa.table([queries.column("a_row")[:0], *[block.column(c)[:0] for c in ("b_row", "b_id", "b_smiles")], pa.array([], pa.float64())], names=[*HIT])
            x, y, floor = measure.matrix(queries.column("a_fp")), measure.matrix(block.column("b_fp")), queries.column("floor").to_numpy()
            b_row, kept = block.column("b_row").to_numpy(), []
            if excluding:
                mine, theirs = (np.array(t.column(c).to_pylist(), object) for t, c in ((queries, "a_smiles"), (block, "b_smiles")))
            for start in range(0, len(x), 128):
                value = measure.similarities(x[start : start + 128], y)
                able = value >= floor[start : start + 128, None]
                if excluding:
                    own = mine[start : start + 128, None]
                    able &= ~((own == theirs) & (own != None))  # noqa: E711
                p, q = np.nonzero(able)
                order = np.lexsort((b_row[q], -value[p, q], p))
                p, q = p[order], q[order]
                place = np.arange(len(p)) - np.searchsorted(p, p)
                p, q = p[place < top], q[place < top]
                kept.append((p + start, q, value[p, q]))
            p, q, value = (np.concatenate(c) for c in zip(*kept, strict=True))
            return pa.table([queries.column("a_row").take(pa.array(p)), *[block.column(c).take(pa.array(q)) for c in ("b_row", "b_id", "b_smiles")], pa.array(value)], names=[*HIT])

        types = dict(asked.dtypes) | dict(there.dtypes) | {"similarity": "double"}
        columns = ["block", "salt", "a_row", "a_fp", "floor", *["a_smiles"] * excluding]
        return asked.select(*columns).groupBy("block", "salt").cogroup(there.groupBy("block", "salt")).applyInArrow(run, ", ".join(f"{c} {types[c]}" for c in HIT))

    def search(self, queries: DataFrame, name: str = "tanimoto", threshold: float | None = 0.0, top: int = 10, include_query: bool = True) -> tuple[DataFrame, DataFrame]:
        """The ``top`` best rows of every query (row, SMILES, fp), and (a_row, visited) how many blocks it took.

        Hits are (a_row, Rank, b_row, b_id, b_smiles, similarity), equal ones by row; with ``threshold`` None there is none. Without
        ``include_query`` rows whose SMILES text equals the query's are left out. The result is that of a search of all rows.
        """
        plan = stored(self.plan(queries, name, threshold), "plan")
        n = plan.select("a_row").distinct().count()
        texts = queries.select(F.col("row").alias("a_row"), F.col("SMILES").alias("a_smiles"))

        def best(found: DataFrame) -> DataFrame:
            rank = F.row_number().over(W.partitionBy("a_row").orderBy(F.desc("similarity"), "b_row"))
            return found.withColumn("Rank", rank).where(F.col("Rank") <= top)

        def kept(wanted: DataFrame) -> DataFrame:
            return self.scored(wanted if include_query else wanted.join(texts, "a_row"), n, name, top)

        floor = F.lit(float("-inf") if threshold is None else threshold)
        near = stored(best(kept(plan.where(F.col("place") <= FIRST).withColumn("floor", floor))), "near")
        kth = near.where(F.col("Rank") == top).select("a_row", F.col("similarity").alias("kth"))
        # what is below a query's k-th best similarity is left out where it is scored, before anything is ranked
        rest = plan.where(F.col("place") > FIRST).join(kth, "a_row", "left").withColumn("floor", F.coalesce("kth", floor)).drop("kth")
        rest = stored(rest.where(F.col("bound") >= F.col("floor")), "rest")
        hits = best(near.drop("Rank").unionByName(kept(rest)))
        visited = plan.where(F.col("place") <= FIRST).select("a_row").unionByName(rest.select("a_row")).groupBy("a_row").agg(F.count("*").alias("visited"))
        return hits, visited


def build_index(library: DataFrame, n_bits: int, path: str | None = None) -> FingerprintIndex:
    """Index a library (row, Compound_ID, SMILES, fp); invalid rows are left out. Without ``path`` it lies in the shared folder."""
    spark, path = library.sparkSession, path or folder(library.sparkSession, "index")
    n_words = -(-n_bits // 64)
    valid = library.where("fp is not null").select("row", "Compound_ID", "SMILES", "fp", bits(words(F.col("fp"), n_bits)).alias("bits"))
    # blocks lie within a range partition, so nothing is counted across partitions
    placed = stored(valid.repartitionByRange("bits", "fp", "row").withColumn("__p", F.spark_partition_id()), "placed")
    at = F.row_number().over(W.partitionBy("__p").orderBy("bits", "fp", "row"))
    block = (F.col("__p").cast("long") * (1 << 32) + F.floor((at - 1) / BLOCK)).alias("block")
    placed.select(block, "row", "Compound_ID", "SMILES", "fp", "bits").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    some, every = ([f(F.col("fp")[w]) for w in range(n_words)] for f in (F.bit_or, F.bit_and))
    rows.groupBy("block").agg(F.count("*").alias("n"), F.min("bits").alias("least"), F.array(*some).alias("any"), F.array(*every).alias("all")).coalesce(1).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps({"n_bits": n_bits}),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return FingerprintIndex(spark, path, n_bits)


def load_index(spark: SparkSession, path: str) -> FingerprintIndex:
    return FingerprintIndex(spark, path, json.loads(spark.read.text(f"{path}/meta").first()[0])["n_bits"])
