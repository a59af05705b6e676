"""The calculator over streams. Each row is its own result, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leadlight.operators.picklists import Picklist, condition
from leadlight.plans.calculator import calculate


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def calculate_stream(stream: DataFrame, picklist: Picklist | None = None, **options: object) -> DataFrame:
    """The compound table of arriving rows, or those that a picklist's filters keep (an order or limit needs all rows)."""
    out = calculate(stream, **options)
    return out.where(condition(out, picklist)) if picklist else out


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends Parquet files, each input file once, until the input is used up."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
