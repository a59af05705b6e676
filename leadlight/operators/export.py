"""Feature export from a frozen specification: one plan from rows to all outputs.

A specification is a versioned JSON text: the blocks with their offsets, and the names inside each. It becomes a layout table (block,
name, column); all named cells of all blocks look their column up at once, hashed ones compute it. What the layout does not
know is counted where it is dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.functions.rules import col, finite
from leadlight.operators.blocks import lookup
from leadlight.operators.features import FRAGMENTS_PER_ROW, blocks, vocabulary
from leadlight.sources.storage import numbered, stored, write_text

VERSION = 1


def specify(rows: DataFrame, named: list[str], fragments: list[str], least: int = 1, hashed: dict[str, int] | None = None) -> str:
    """A specification from rows: numeric columns ``named`` as block Named, and a vocabulary block for each column of fragments."""
    names = {"Named": list(named)}
    for block in fragments:
        names[block] = [r["fragment"] for r in vocabulary(rows, block, least).orderBy("column").collect()]  # a vocabulary is what the file holds
    laid = blocks({k: len(v) for k, v in names.items()}, hashed)
    return json.dumps({"spec_version": VERSION, "blocks": [vars(b) for b in laid.values()], "names": names}, indent=2)


def read_spec(spec: str) -> dict:
    found = json.loads(spec)
    if not isinstance(found, dict) or "spec_version" not in found:
        raise ValueError("the specification has no spec_version")
    if found["spec_version"] > VERSION:
        raise ValueError(f"specification version {found['spec_version']} is newer than {VERSION}")
    return found


def layout(spark: SparkSession, spec: str) -> DataFrame:
    """(block, name, column int) of all named columns of a specification."""
    found = read_spec(spec)
    offset = {b["name"]: b["offset"] for b in found["blocks"]}
    return spark.createDataFrame([(b, n, offset[b] + i) for b, names in found["names"].items() for i, n in enumerate(names)], "block string, name string, column int")


def _present(block: str, fragments: Column) -> Column:
    return F.transform(fragments, lambda f: F.struct(F.lit(block).alias("block"), f.alias("name"), F.lit(1.0).cast("float").alias("value")))


def export(rows: DataFrame, row: str, spec: str, counts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(row, indices, values, start) of every row, and (block, name, n) of what was dropped.

    rows: ``row`` (unique), the specification's numeric columns, a list column for each of its fragment blocks, and for hashed
    blocks the map columns that ``counts`` names {block: column}. ``start`` is where a row's cells begin in the whole matrix, rows
    in order. Zeros, nulls and what is not finite are no cells; a fragment counts once, and of a row the first FRAGMENTS_PER_ROW by name.
    """
    found = read_spec(spec)
    sizes = {b["name"]: b for b in found["blocks"]}
    cells = []
    for c in found["names"].get("Named", ()):
        cells.append(F.array(F.struct(F.lit("Named").alias("block"), F.lit(c).alias("name"), finite(col(c)).cast("float").alias("value"))))
    for b in found["names"]:
        if b != "Named":
            one = F.slice(F.array_sort(F.array_distinct(F.coalesce(col(b), F.array().cast("array<string>")))), 1, FRAGMENTS_PER_ROW)
            cells.append(_present(b, one))
    named = rows.select(col(row).alias("row"), F.explode(F.concat(*cells)).alias("c")).select("row", "c.*").where("name is not null and value is not null and value <> 0")
    placed = stored(lookup(named, layout(rows.sparkSession, spec), ["block", "name"], "left"), "cells")
    dropped = placed.where("column is null").groupBy("block", "name").agg(F.count("*").alias("n"))
    whole = placed.where("column is not null").select("row", "column", "value")
    for block, column in counts.items():
        hashed = rows.select(col(row).alias("row"), F.explode(col(column)).alias("key", "n"))
        at = (F.pmod(F.col("key").cast("long"), F.lit(sizes[block]["size"])) + sizes[block]["offset"]).cast("int").alias("column")
        whole = whole.unionByName(hashed.groupBy("row", at).agg(F.sum("n").cast("float").alias("value")))
    packed = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("c"))
    every = rows.select(col(row).alias("row")).join(packed, "row", "left")
    every = stored(every.select("row", F.coalesce(F.col("c.column"), F.array().cast("array<int>")).alias("indices"), F.coalesce(F.col("c.value"), F.array().cast("array<float>")).alias("values")), "rows")
    starts = numbered(every.select("row", F.size("indices").alias("n")), [F.col("row")], "start", weight=F.col("n")).select("row", "start")
    return every.join(starts, "row"), dropped


def write_export(rows: DataFrame, row: str, ident: str, spec: str, counts: dict[str, str], folder: str) -> None:
    """``export`` below ``folder``: matrix (Parquet by ranges of rows), ids, dropped, and the specification itself as spec.json."""
    matrix, dropped = export(rows, row, spec, counts)
    matrix.repartitionByRange("row").sortWithinPartitions("row").write.mode("overwrite").parquet(f"{folder}/matrix")
    rows.select(col(row).alias("row"), col(ident).alias("id")).write.mode("overwrite").parquet(f"{folder}/ids")
    dropped.write.mode("overwrite").parquet(f"{folder}/dropped")
    write_text(rows.sparkSession, f"{folder}/spec.json", spec)
