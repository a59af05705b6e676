"""Schema validation: required, unknown and mistyped columns, one aggregation for the whole table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.plans.categories import category_columns

# Texts that count as a flag.
TRUE, FALSE = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")
TYPES = ("string", "float", "int", "bool", "auto", "any")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "auto"
    required: bool = False
    units: str = ""
    tags: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Schema:
    columns: dict[str, ColumnSpec]
    patterns: tuple[tuple[str, ColumnSpec], ...] = field(default=())

    def find(self, name: str) -> ColumnSpec | None:
        """The column's own entry, or the first family whose pattern occurs in its name."""
        if name in self.columns:
            return self.columns[name]
        return next((s for p, s in self.patterns if re.search(p, name)), None)


def load_schema(text: str) -> Schema:
    raw = json.loads(text)
    spec = lambda name, e: ColumnSpec(name, e.get("type", "auto"), bool(e.get("required")), e.get("units") or "", tuple(e.get("tags") or ()), e.get("description") or "")
    entries = raw.get("columns", {})
    entries = entries.items() if isinstance(entries, dict) else [(e["name"], e) for e in entries]
    return Schema({n: spec(n, e) for n, e in entries}, tuple((e["pattern"], spec(e["pattern"], e)) for e in raw.get("patterns", ())))


def find_schema(spark, path: str | None = None, bundled: Schema | None = None) -> Schema:
    """The schema at ``path`` if there is one, else ``bundled``, else one made of the known categories' columns."""
    if path is not None:
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
            return load_schema("\n".join(r["value"] for r in spark.read.text(path).collect()))
    if bundled is not None:
        return bundled
    from leadlight.plans.categories import CATEGORIES

    return Schema({name: ColumnSpec(name, "auto", False, "", (key,), "") for key, c in CATEGORIES.items() for name in c.columns}, ())


def coerces(c: Column, kind: str, to: str) -> Column:
    """Whether a non-null value can be read as a type."""
    number = c.cast("double") if kind in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") else c.try_cast("double")
    if to == "float":
        return number.isNotNull()
    if to == "int":
        return number.isNotNull() & (F.round(number) == number)
    if to == "bool":
        return F.lower(F.trim(c.cast("string"))).isin(*TRUE, *FALSE, "1.0", "0.0")
    return F.lit(True)


def coercion_ratios(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, type, n, ratio): which share of the non-null values can be read as the type; 1 without values."""
    kinds, cells, aggs = dict(df.dtypes), [], []
    for i, (name, to) in enumerate(types.items()):
        c = F.nanvl(col(name), F.lit(None)) if kinds[name] in ("double", "float") else col(name)
        good = F.coalesce(coerces(c, kinds[name], to), F.lit(False))
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.isNotNull() & good).alias(f"g{i}")]
        cells.append(F.struct(F.lit(name).alias("column"), F.lit(to).alias("type"), F.col(f"n{i}").alias("n"), F.coalesce(F.try_divide(F.col(f"g{i}").cast("double"), F.col(f"n{i}")), F.lit(1.0)).alias("ratio")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


@dataclass(frozen=True)
class Report:
    missing: tuple[str, ...]
    empty_categories: tuple[str, ...]
    unknown: tuple[str, ...]
    mistyped: tuple[tuple[str, str, float], ...]

    @property
    def passed(self) -> bool:
        return not (self.missing or self.empty_categories or self.mistyped)

    def text(self) -> str:
        lines = [f"missing required column: {c}" for c in self.missing] + [f"category without columns: {c}" for c in self.empty_categories]
        lines += [f"unknown column: {c}" for c in self.unknown] + [f"{c}: {ratio:.1%} can be read as {kind}" for c, kind, ratio in self.mistyped]
        return "\n".join([*lines, f"Result: {'PASS' if self.passed else 'FAIL'}"])


def validate(df: DataFrame, schema: Schema, categories: Iterable[str] = (), least: float = 0.95, strict_unknown: bool = False) -> Report:
    """Checks a table; unknown columns fail only if asked. One job, whatever the number of columns."""
    missing = tuple(n for n, s in schema.columns.items() if s.required and n not in df.columns)
    empty = tuple(k for k in categories if not category_columns(df.columns, k))
    found = {c: s for c in df.columns if (s := schema.find(c))}
    unknown = tuple(c for c in df.columns if c not in found)
    types = {c: s.type for c, s in found.items() if s.type in ("float", "int", "bool")}
    rows = coercion_ratios(df, types).collect() if types else []
    bad = tuple((r["column"], r["type"], r["ratio"]) for r in rows if r["ratio"] < least)
    return Report(missing + (unknown if strict_unknown else ()), empty, unknown, bad)


def schema_markdown(schema: Schema) -> str:
    """The columns by their first tag, sorted, then the families."""
    groups: dict[str, list[ColumnSpec]] = {}
    for s in schema.columns.values():
        groups.setdefault(s.tags[0] if s.tags else "other", []).append(s)
    lines = ["# Columns"]
    for tag in sorted(groups):
        lines += ["", f"## {tag}", "", "| column | type | units | required | description |", "|-|-|-|-|-|"]
        lines += [f"| {s.name} | {s.type} | {s.units} | {'yes' if s.required else ''} | {s.description} |" for s in sorted(groups[tag], key=lambda s: s.name)]
    if schema.patterns:
        lines += ["", "## Families", "", "| pattern | type | description |", "|-|-|-|"] + [f"| `{p}` | {s.type} | {s.description} |" for p, s in schema.patterns]
    return "\n".join(lines) + "\n"
