"""Ordered and limited picklists over streams: the best rows of each list so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadlight.functions.rules import col
from leadlight.operators.picklists import Picklist, run_together

#: Versions of the kept rows that stay; older ones are deleted.
VERSIONS = 3


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [f.getPath().getName() for f in store.listStatus(path)]
    done = [n for n in names if n.startswith("v") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def best_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(picklist, rank, columns) of the newest version below ``folder``."""
    return spark.read.parquet(f"{folder}/v{_versions(spark, folder)[-1]}")


def keep_best(stream: DataFrame, picklists: list[Picklist], tie: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps, below ``folder``, what the lists would hold if all rows so far were one table.

    Every list has a limit, so what is kept is bounded; ``tie`` is a unique column. A micro-batch is ranked together with the rows
    kept before it: each list keeps its best rows of each partition, then of all. Its version has the number of the micro-batch,
    so a batch that runs again after a failure starts from the version before it and writes the same rows. Text columns are
    ordered as text, since a stream has no last row that would say whether all are numbers.
    """
    if endless := [p.key for p in picklists if p.limit <= 0]:
        raise ValueError(f"lists without a limit: {', '.join(endless)}")

    def turn(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, folder) if v < number]
        rows = batch
        if before:
            kept = spark.read.parquet(f"{folder}/v{before[-1]}").drop("picklist", "rank").dropDuplicates([tie])
            rows = batch.join(kept.select(col(tie)), tie, "left_anti").select(*[col(c) for c in batch.columns]).unionByName(kept)
        run_together(rows.dropDuplicates([tie]), picklists, tie, []).write.mode("overwrite").parquet(f"{folder}/v{number}")
        for v in before[: -VERSIONS + 1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{v}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ordered(rows: DataFrame, key: str) -> DataFrame:
    """One list in its order."""
    return rows.where(F.col("picklist") == key).orderBy("rank")
