"""Intermediate tables in the folder that the cluster shares, and row numbers at any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or the warehouse of a local session where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage of iterations; the files are shared, so a lost executor loses nothing. ``dropped`` deletes them.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.leadlight_path = path
    return written


def dropped(written: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.leadlight_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def numbered(df: DataFrame, order: list[Column], name: str = "row_index", weight: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """With a column that counts, over all rows in ``order``, the rows before (or the sum of ``weight`` before).

    ``more`` are further columns with weights of their own, numbered in the same pass. Rows are range partitioned by the order
    and counted within their partition; only one number for each partition is summed up in one place. ``order`` should settle ties.
    """
    weights = {name: F.lit(1) if weight is None else weight} | (more or {})
    placed = df.withColumns({f"__w{i}": w.cast("long") for i, w in enumerate(weights.values())}).orderBy(*order)
    placed = stored(placed.withColumn("__p", F.spark_partition_id()), "numbered")
    sums = placed.groupBy("__p").agg(*[F.sum(f"__w{i}").alias(f"__s{i}") for i in range(len(weights))])
    before = sums.select("__p", *[(F.sum(f"__s{i}").over(W.orderBy("__p")) - F.col(f"__s{i}")).alias(f"__b{i}") for i in range(len(weights))])
    rows = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    at = {n: F.col(f"__b{i}") + F.sum(f"__w{i}").over(rows) - F.col(f"__w{i}") for i, n in enumerate(weights)}
    return placed.join(before, "__p").withColumns(at).drop("__p", *[f"__{k}{i}" for i in range(len(weights)) for k in "bw"])
