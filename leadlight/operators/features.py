"""Feature export: vocabularies, sparse rows with fixed blocks, packed bits, dense columns, graph offsets.

The matrix stays long or one sparse row for each compound; nothing of the size of the data comes to the driver. Only
the vocabulary of fragments is numbered, by a range-partitioned sort.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.functions.rules import col, finite
from leadlight.operators.blocks import lookup
from leadlight.sources.storage import numbered, stored

# Block names and widths of the sparse matrix, in order, and the preferred dense columns.
HASHED = {"FP_Morgan": 4096, "FP_AtomPair": 2048, "FP_Torsion": 2048}
DENSE = ("MolWt", "LogP", "TPSA", "HBD", "HBA", "RotBonds", "Rings", "AromaticRings", "HeavyAtoms", "FractionCSP3", "QED", "cLogD_7.4", "pKa_Basic", "pKa_Acidic", "CNS_MPO", "Dev_Score")
FRAGMENTS_PER_ROW = 128


@dataclass(frozen=True)
class Block:
    name: str
    size: int
    offset: int


def blocks(named: dict[str, int], hashed: dict[str, int] | None = None) -> dict[str, Block]:
    """The blocks of a matrix: hashed ones first, then named ones of the given sizes, each after the one before."""
    out, offset = {}, 0
    for name, size in {**(HASHED if hashed is None else hashed), **named}.items():
        out[name] = Block(name, size, offset)
        offset += size
    return out


def fragment_counts(rows: DataFrame, fragments: str = "fragments", most: int = FRAGMENTS_PER_ROW) -> DataFrame:
    """(fragment, n): in how many rows each fragment stands; of a row the first ``most`` by name count."""
    one = F.slice(F.array_sort(F.array_distinct(F.coalesce(col(fragments), F.array().cast("array<string>")))), 1, most)
    return rows.select(F.explode(one).alias("fragment")).groupBy("fragment").agg(F.count("*").alias("n"))


def vocabulary(rows: DataFrame, fragments: str = "fragments", least: int = 1, most: int = FRAGMENTS_PER_ROW) -> DataFrame:
    """(fragment, column): the fragments that at least ``least`` rows have, numbered by name from 0."""
    return numbered(fragment_counts(rows, fragments, most).where(F.col("n") >= least).select("fragment"), [F.col("fragment")], "column").withColumn("column", F.col("column").cast("int"))


def unknown_fragments(rows: DataFrame, known: DataFrame, fragments: str = "fragments") -> DataFrame:
    """(fragment, n) of fragments outside a frozen vocabulary, which an export drops."""
    return fragment_counts(rows, fragments).join(known.select("fragment"), "fragment", "left_anti")


def hashed_cells(rows: DataFrame, row: str, counts: str, block: Block) -> DataFrame:
    """(row, column, value): a map of feature keys to counts, folded by key modulo the block's width and summed."""
    return hashed_blocks(rows, row, {counts: block})


def hashed_blocks(rows: DataFrame, row: str, counts: dict[str, Block]) -> DataFrame:
    """The same of several maps in one pass; the maps are shuffled by row, so that their cells need not be."""
    columns = [(f"m{i}", block) for i, block in enumerate(counts.values())]
    maps = rows.select(col(row).alias("row"), *[col(c).alias(m) for c, (m, _) in zip(counts, columns, strict=True)]).repartition("row")
    folded = lambda block: lambda e: F.struct((F.pmod(e["key"].cast("long"), F.lit(block.size)) + block.offset).cast("int").alias("column"), e["value"].cast("double").alias("n"))
    entries = F.concat(*[F.coalesce(F.transform(F.map_entries(m), folded(block)), F.array().cast("array<struct<column:int,n:double>>")) for m, block in columns])
    cells = maps.select("row", F.explode(entries).alias("c")).select("row", "c.column", "c.n")
    return cells.groupBy("row", "column").agg(F.sum("n").cast("float").alias("value"))


def named_cells(rows: DataFrame, row: str, values: dict[str, str], block: Block) -> DataFrame:
    """(row, column, value) of named numeric columns {feature: column}; zeros and nulls are no cells."""
    entries = F.array(*[F.struct(F.lit(block.offset + i).alias("column"), finite(col(c)).cast("float").alias("value")) for i, c in enumerate(values.values())])
    return rows.select(col(row).alias("row"), F.explode(entries).alias("c")).select("row", "c.column", "c.value").where("value is not null and value <> 0")


def presence_cells(rows: DataFrame, row: str, known: DataFrame, block: Block, fragments: str = "fragments", most: int = FRAGMENTS_PER_ROW) -> DataFrame:
    """(row, column, value 1) of the fragments that a vocabulary knows, see ``lookup``."""
    one = F.slice(F.array_sort(F.array_distinct(col(fragments))), 1, most)
    cells = rows.select(col(row).alias("row"), F.explode(one).alias("fragment"))
    return lookup(cells, known, ["fragment"]).select("row", (F.col("column") + block.offset).cast("int").alias("column"), F.lit(1.0).cast("float").alias("value"))


def sparse_rows(rows: DataFrame, row: str, cells: DataFrame) -> DataFrame:
    """(row, indices array<int>, values array<float>) for every row, columns ascending; rows without cells are empty."""
    packed = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("c"))
    out = rows.select(col(row).alias("row")).join(packed, "row", "left")
    return out.select("row", F.coalesce(F.col("c.column"), F.array().cast("array<int>")).alias("indices"), F.coalesce(F.col("c.value"), F.array().cast("array<float>")).alias("values"))


def row_pointers(sparse: DataFrame) -> DataFrame:
    """With the start of each row's cells in the whole matrix (the CSR index pointer)."""
    return numbered(sparse, [F.col("row")], "start", weight=F.size("indices"))


def dense_columns(columns: list[str], explicit: str | None = None) -> list[str]:
    """The asked columns that exist, or the preferred ones and then every Dev_ column."""
    if explicit:
        return [c for c in (x.strip() for x in explicit.split(",")) if c and c in columns]
    first = [c for c in DENSE if c in columns]
    return first + [c for c in columns if c.startswith("Dev_") and c not in first]


def dense_rows(df: DataFrame, row: str, explicit: str | None = None) -> DataFrame:
    """(row, features array<float>); booleans are 1 and 0, what is no number is null."""
    kinds = dict(df.dtypes)
    number = lambda c: col(c).cast("float") if kinds[c] == "boolean" else finite(col(c)).cast("float")
    return df.select(col(row).alias("row"), F.array(*[number(c) for c in dense_columns(df.columns, explicit)]).alias("features"))


def freeze(named: dict[str, list[str]], hashed: dict[str, int] | None = None) -> str:
    """A specification as JSON: the blocks and the names inside them; with it later exports have the same columns."""
    laid = blocks({k: len(v) for k, v in named.items()}, hashed)
    return json.dumps({"blocks": [vars(b) for b in laid.values()], "names": named}, indent=2)


def frozen_vocabulary(spark: SparkSession, spec: str, block: str) -> DataFrame:
    """(fragment, column) of a block of a frozen specification."""
    names = json.loads(spec)["names"][block]
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "fragment string, column int")


def graph_offsets(graphs: DataFrame) -> DataFrame:
    """Rows (row, n_atoms, n_edges) with atom_start and edge_start, the places of each graph in the joined tensors.

    The sizes are written first: bounds of ranges are sampled, and what made the graphs would run once more for that.
    """
    return numbered(stored(graphs, "graphs"), [F.col("row")], "atom_start", weight=F.col("n_atoms"), more={"edge_start": F.col("n_edges")})


def packed_bytes(bits: str, n_bits: int) -> object:
    """A boolean array as bytes, the first flag as the highest bit of the first byte."""
    text = F.array_join(F.transform(col(bits), lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0"))), "")
    padded = F.rpad(text, -(-n_bits // 8) * 8, "0")
    return F.unhex(F.lpad(F.conv(padded, 2, 16), -(-n_bits // 8) * 2, "0")) if n_bits <= 64 else F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(-(-n_bits // 8) * 8 - 7), F.lit(8)), lambda i: F.lpad(F.conv(F.substring(padded, i, F.lit(8)), 2, 16), 2, "0")), ""))
