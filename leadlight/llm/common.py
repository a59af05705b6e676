"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step holds at a time; longer single texts make a step of their own.
STEP_BYTES = 4 << 20


#: Bytes of an Arrow batch on its way to Python; Spark's default of 64 MB fills small executors.
ARROW_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark so that any store works.

    The session's Arrow batches are held to ARROW_BYTES from then on.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches: Iterable[pa.RecordBatch], size_of: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column ``size_of`` (string or binary) holds about ``limit`` bytes at most.

    A single value above the limit still comes whole, alone in its batch. Empty batches are left out.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(size_of))
        if column.nbytes <= limit:
            yield batch
            continue
        start = size = 0
        lengths = pc.binary_length(column).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Where the setting is empty a local session's warehouse folder serves; on a cluster that is an error, as the folder
    might be on one machine only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{root.rstrip('/')}/leadlight-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, executors may be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.leadlight_path = path
    return written


def discard(written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written.leadlight_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(column: str = "text") -> object:
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def in_fold(doc_id: str, folds: int, fold: int) -> object:
    """True where crc32 of the id's decimal text leaves ``fold`` modulo ``folds``."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds) == fold, F.lit(False))


def keep_rows(docs: DataFrame, text_column: str, decide: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows whose text ``decide`` keeps (it gets the texts of a batch), with all their columns as they are.

    Columns travel under names of their own, so none can clash. One narrow stage without a shuffle.
    """
    at = docs.columns.index(text_column)
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, f"c{at}"):
            yield batch.filter(pa.array(decide(batch.column(at)), pa.bool_()))

    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
