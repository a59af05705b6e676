"""Tables in and out: CSV, TSV and Parquet, export order, metadata beside the output, nested solver results."""

from __future__ import annotations

import hashlib
import json
import platform
import sys
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadlight.functions.rules import col, finite
from leadlight.plans.calculator import export_order, fill_missing

FORMATS = {".parquet": "parquet", ".pq": "parquet", ".tsv": "tsv", ".tab": "tsv"}
#: Files above so many bytes get no checksum.
CHECKSUM_LIMIT = 200 * 1024 * 1024


def detect_format(path: str, fmt: str | None = None) -> str:
    """The given format, or the one of the file's ending, csv by default."""
    if fmt is not None:
        if fmt.lower() not in ("csv", "tsv", "parquet"):
            raise ValueError(f"unknown format {fmt!r}")
        return fmt.lower()
    return FORMATS.get(PurePosixPath(path).suffix.lower(), "csv")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A compound table. With a schema nothing is scanned to infer types. NaN and infinities become null."""
    kind = detect_format(path, fmt)
    if kind == "parquet":
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').option("multiLine", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumns({n: finite(col(n)).cast(k) for n, k in df.dtypes if k in ("double", "float")})


def write_table(df: DataFrame, path: str, fmt: str | None = None, ordered: bool = True, fill: float | None = None) -> None:
    """The table in export order (for every format), with missing cells filled if asked. Spark writes a folder of parts."""
    out = df.select(*[col(c) for c in (export_order(df.columns) if ordered else df.columns)])
    out = fill_missing(out, fill) if fill is not None else out
    kind = detect_format(path, fmt)
    if kind == "parquet":
        out.write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified, sha256) of the files of a path, read by Spark; no checksum above CHECKSUM_LIMIT."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    small = spark.read.format("binaryFile").load(path).where(F.col("length") <= CHECKSUM_LIMIT).select("path", F.sha2("content", 256).alias("sha256"))
    return listed.join(small, "path", "left").select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "sha256")


def metadata(spark: SparkSession, tool: str, inputs: list[str], parameters: dict[str, object]) -> str:
    """The JSON that stands beside an output: tool, arguments, versions, inputs, parameters."""
    files = [r.asDict() | {"modified": r["modified"].isoformat()} for p in inputs for r in checksum(spark, p).collect()]
    return json.dumps({"tool": tool, "created": datetime.now(UTC).isoformat(timespec="seconds"), "argv": sys.argv, "versions": {"python": platform.python_version(), "spark": spark.version}, "inputs": files, "parameters": parameters, "parameters_sha256": hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()}, indent=2, default=str)


def retro_targets(df: DataFrame, smiles: str, limit: int | None = None) -> DataFrame:
    """Rows with a usable structure text; the limit counts after blanks, "nan" and "none" are gone."""
    text = F.lower(F.trim(col(smiles)))
    kept = df.where(col(smiles).isNotNull() & ~text.isin("", "nan", "none"))
    return kept.limit(limit) if limit else kept


def flatten_routes(results: DataFrame, targets: DataFrame, index: str = "row_index", n_routes: int = 3) -> DataFrame:
    """One row for each target from nested route-search results, joined by an explicit row index, not by position.

    Takes columns target, is_solved, number_of_solved_routes, number_of_routes, top_score, search_time and trees (an array
    of JSON texts), as far as they are there; of the trees the first ``n_routes`` stay.
    """
    have = set(results.columns)
    get = lambda name, kind: (col(name).cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)
    trees = F.slice(F.coalesce(col("trees"), F.array().cast("array<string>")), 1, n_routes) if "trees" in have else F.array().cast("array<string>")
    flat = results.select(col(index), get("target", "string"), get("is_solved", "boolean"), get("number_of_solved_routes", "int"), get("number_of_routes", "int"), get("top_score", "double"), get("search_time", "double"), trees.alias("routes"))
    out = targets.join(flat, index, "left")
    return out.withColumns({"n_routes_exported": F.coalesce(F.size("routes"), F.lit(0)), "routes_json": F.concat(F.lit("["), F.array_join("routes", ","), F.lit("]"))}).drop("routes")
