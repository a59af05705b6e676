"""Structure lists: text lines with a name and a SMILES, in the three dialects that the tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.plans.categories import smiles_column
from leadlight.sources.storage import numbered
from leadlight.sources.tables import read_table

# Characters that mark a token as a structure, for each dialect.
MARKS = {"calculator": r"[\[\]=#@()]", "similarity": r"[CNOcnoPSFlBrI()=#]", "retro": r"[\[\]=#()]"}
NAMES = {"calculator": "cmpd_", "similarity": "Compound_", "retro": "row"}


def parse_lines(lines: DataFrame, dialect: str = "calculator") -> DataFrame:
    """(row, Compound_ID, SMILES) of lines (line long from 1, value string); blank and # lines are skipped.

    "calculator": split by tab, else comma, else white space; of two tokens the one with a structure mark is the SMILES, and
    if both or neither have one, the second. "similarity": white space only; the SMILES is the first token if it has a
    mark. "retro": the first and the last token by white space, the first being the SMILES if it has a mark.
    A single token is a SMILES with a name by its line.
    """
    if dialect not in MARKS:
        raise ValueError(f"unknown dialect {dialect!r}")
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    kept = lines.select("line", text.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    t = F.col("t")
    blank = F.split(t, r"\s+")
    tokens = F.when(t.contains("\t"), F.split(t, "\t")).when(t.contains(","), F.split(t, ",")).otherwise(blank) if dialect == "calculator" else blank
    tokens = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != "")
    rows = kept.withColumn("tokens", tokens).where(F.size("tokens") > 0)
    first = F.col("tokens").getItem(0)
    second = F.element_at("tokens", F.when(F.size("tokens") > 1, F.lit(-1 if dialect == "retro" else 2)).otherwise(1))
    mark: Column = F.lit(MARKS[dialect])
    a, b = F.regexp_like(first, mark), F.regexp_like(second, mark)
    swap = (a & ~b) if dialect == "calculator" else a
    single = F.size("tokens") == 1
    name = F.when(single, F.concat(F.lit(NAMES[dialect]), F.col("line").cast("string"))).when(swap, second).otherwise(first)
    return rows.select(F.col("line").alias("row"), name.alias("Compound_ID"), F.when(single | swap, first).otherwise(second).alias("SMILES"))


def read_smiles(spark: SparkSession, path: str, dialect: str = "calculator") -> DataFrame:
    """A structure list from a text file of any size; lines are numbered from 1 by where they stand, in Spark's splits of the file."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")]
    lines = spark.read.text(path).select(*at, "value")
    placed = numbered(lines, [F.col("file"), F.col("start"), F.col("place")], "line")
    return parse_lines(placed.select((F.col("line") + 1).cast("long").alias("line"), "value"), dialect)


def load_library(spark: SparkSession, source: DataFrame | list[str] | str, smiles: str = "SMILES", ident: str = "Compound_ID") -> DataFrame:
    """(row, Compound_ID, SMILES) from a list, a table, a table file or a structure list.

    Ids come from the asked column, Compound_ID, Name or name, else from the row's number.
    """
    if isinstance(source, list):
        rows = [(i, f"Compound_{i + 1}", s) for i, s in enumerate(source)]
        return spark.createDataFrame(rows, "row long, Compound_ID string, SMILES string")
    if isinstance(source, str):
        if not source.lower().endswith((".csv", ".parquet")):
            return read_smiles(spark, source, "similarity")
        source = read_table(spark, source)
    structure = smiles_column(source.columns, preferred=smiles)
    if structure is None:
        raise ValueError("no structure column")
    name = next((c for c in (ident, "Compound_ID", "Name", "name") if c in source.columns), None)
    ordered = source if "row" in source.columns else numbered(source.withColumn("__id", F.monotonically_increasing_id()), [F.col("__id")], "row").drop("__id")
    given = col(name).cast("string") if name else F.concat(F.lit("Compound_"), (F.col("row") + 1).cast("string"))
    return ordered.select("row", given.alias("Compound_ID"), col(structure).alias("SMILES"))
