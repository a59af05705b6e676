"""Picklists: declarative filter, sort, limit and projection over a compound table.

A definition becomes one lazy DataFrame: masks with two values (never null), a stable order with nulls last, a
limit that Spark runs as a top-k. What a table lacks is settled on the driver from its schema.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.sources.storage import numbered, stored
from leadlight.plans.categories import CATEGORIES, category_columns

OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "in", "notin", "contains", "notcontains", "isnull", "notnull", "between")
MISSING = ("warn_skip", "false", "fail")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
#: Columns of the minimal projection after which a category adds no more.
PROJECTION = 24


@dataclass(frozen=True)
class Rule:
    column: str
    op: str
    value: object = None
    value2: object = None
    missing: str = "warn_skip"


@dataclass(frozen=True)
class Order:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class Picklist:
    key: str
    name: str
    description: str = ""
    logic: str = "all"
    filters: tuple[Rule, ...] = ()
    sort: tuple[Order, ...] = ()
    limit: int = 0
    include_categories: tuple[str, ...] = ()
    output_columns: tuple[str, ...] = field(default=())


# The three lists that come with the toolkit.
BUILTIN: dict[str, Picklist] = {
    p.key: p
    for p in (
        Picklist(
            "top_cns_followup",
            "Top CNS follow-up",
            "Strong CNS balance without an obvious red flag",
            filters=(Rule("CNS_MPO", ">=", 4.5), Rule("RO5_Pass", "==", True), Rule("Tox_Risk", "notin", ["High"]), Rule("hERG_Risk", "notin", ["High"])),
            sort=(Order("CNS_MPO", False),),
            limit=50,
            include_categories=("cns_mpo", "rule_of_5", "toxicity", "herg"),
        ),
        Picklist(
            "oral_low_ddi_risk",
            "Oral low-DDI risk",
            "Oral property rules with a low CYP burden",
            filters=(Rule("Bioavail_Score", ">=", 3), Rule("RO5_Violations", "<=", 1), Rule("CYP_Total_Inhibition", "<=", 1), Rule("CYP_MBI_Risk", "notin", [True, "True", "Yes", "Y"]), Rule("Tox_Risk", "notin", ["High"])),
            sort=(Order("Bioavail_Score", False), Order("CYP_Total_Inhibition")),
            limit=100,
            include_categories=("oral_bioavailability", "rule_of_5", "cyp", "toxicity"),
        ),
        Picklist(
            "high_risk_deprioritize",
            "High risk – deprioritize",
            "Any strong red flag",
            logic="any",
            filters=(
                Rule("Tox_Risk", "in", ["High"]),
                Rule("hERG_Risk", "in", ["High"]),
                Rule("CYP_Total_Inhibition", ">=", 3),
                Rule("CYP_MBI_Risk", "in", [True, "True", "Yes", "Y"]),
                Rule("MedChem_Alerts", ">=", 2),
                Rule("RO5_Violations", ">=", 2),
                Rule("Sol_Consensus_LogS", "<=", -5),
            ),
            sort=(Order("Tox_Total_Alerts", False), Order("MedChem_Alerts", False)),
            include_categories=("toxicity", "herg", "cyp", "medchem_flags", "rule_of_5", "solubility"),
        ),
    )
}


def _number(c: Column, kind: str) -> Column:
    """As double, null where it can't be read or is NaN."""
    d = c.cast("double") if kind in NUMERIC or kind == "boolean" else c.try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def _equals(c: Column, kind: str, value: object) -> Column | None:
    """Equality within one type: a boolean is 1 or 0 as a number, text equals text only. None if it can never hold."""
    if kind in NUMERIC and isinstance(value, (bool, int, float)):
        return c.cast("double") == float(value)
    if kind == "boolean" and isinstance(value, (bool, int, float)):
        return c == bool(value) if value in (0, 1) else None
    if kind == "string" and isinstance(value, str):
        return c == value
    return None


def _among(c: Column, kind: str, values: Iterable[object]) -> Column:
    hits = [e for v in values if (e := _equals(c, kind, v)) is not None]
    return F.coalesce(reduce(or_, hits), F.lit(False)) if hits else F.lit(False)


def mask(df: DataFrame, rule: Rule, logic: str = "all") -> Column:
    """The rule as a condition that is true or false for every row.

    Negations keep null rows. Comparisons read text as numbers; what is no number fails. A column that the table
    lacks raises, is false, or is left out with a warning, as the rule says.
    """
    if rule.op not in OPERATORS:
        raise ValueError(f"unknown operator {rule.op!r}")
    if rule.column not in df.columns:
        if rule.missing == "fail":
            raise ValueError(f"missing column {rule.column!r}")
        if rule.missing == "false":
            return F.lit(False)
        warnings.warn(f"column {rule.column!r} is missing; its rule is left out", stacklevel=2)
        return F.lit(logic == "all")
    kind, c = dict(df.dtypes)[rule.column], col(rule.column)
    null = c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()
    true = lambda x: F.coalesce(x, F.lit(False))
    if rule.op in ("isnull", "notnull"):
        return null if rule.op == "isnull" else ~null
    if rule.op in ("==", "!="):
        same = _among(c, kind, [rule.value])
        return same if rule.op == "==" else ~same
    if rule.op in ("in", "notin"):
        values = rule.value if isinstance(rule.value, (list, tuple, set)) else [rule.value]
        found = _among(c, kind, values)
        return found if rule.op == "in" else ~found
    if rule.op in ("contains", "notcontains"):
        found = F.lower(F.coalesce(c.cast("string"), F.lit(""))).contains("" if rule.value is None else str(rule.value).lower())
        return found if rule.op == "contains" else ~found
    number = _number(c, kind)
    if rule.op == "between":
        return true(number.between(float(rule.value), float(rule.value2)))
    bound = float(rule.value)
    return true({">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound}[rule.op])


def condition(df: DataFrame, picklist: Picklist) -> Column:
    """All rules joined; "any" of no rules is false for every row. Any other logic than "all" and "any" raises."""
    if picklist.logic not in ("all", "any"):
        raise ValueError(f"unknown logic {picklist.logic!r}")
    masks = [mask(df, r, picklist.logic) for r in picklist.filters]
    if picklist.logic == "any":
        return reduce(or_, masks, F.lit(False))
    return reduce(and_, masks, F.lit(True))


def ordering(df: DataFrame, orders: Iterable[Order], tie: str | None) -> list[Column]:
    """Sort columns with nulls and NaN last, then ``tie``; columns that the table lacks are left out.

    A text column of which every value is a number is ordered by number (one job finds out for all of them).
    """
    orders = list(orders)
    kinds, keys, numbers = dict(df.dtypes), [], numeric_text_columns(df, [o.column for o in orders])
    for o in orders:
        if o.column in kinds:
            c = F.nanvl(col(o.column), F.lit(None)) if kinds[o.column] in ("double", "float") else col(o.column).try_cast("double") if o.column in numbers else col(o.column)
            keys.append(c.asc_nulls_last() if o.ascending else c.desc_nulls_last())
    return keys + ([col(tie).asc_nulls_last()] if tie else [])


def run_picklist(df: DataFrame, picklist: Picklist, tie: str | None = None) -> DataFrame:
    """Filter, sort, limit. ``tie`` is a column that settles equal keys (a row number or the id)."""
    kept = df.where(condition(df, picklist))
    keys = ordering(df, picklist.sort, tie)
    if any(o.column in df.columns for o in picklist.sort):
        kept = kept.orderBy(*keys)
    return kept.limit(picklist.limit) if picklist.limit > 0 else kept


def run_together(df: DataFrame, picklists: list[Picklist], tie: str, numbers: list[str] | None = None) -> DataFrame:
    """The rows of all lists from one scan: picklist (its key), rank from 1, and the table's columns.

    Each row gets the keys of the lists that keep it and is exploded by them. Sort keys of different lists share a few columns: for
    every place of an order one that says what is null, one for numbers (negative where they fall) and one for texts in either
    direction. Lists with a limit keep their best rows of each partition before they are shuffled; lists without are numbered by
    range partitions, however long they are. The number of jobs does not depend on the number of lists. ``numbers`` names the
    text columns that are ordered as numbers; by default one job finds out.
    """
    if len({p.key for p in picklists}) < len(picklists):
        raise ValueError("two picklists have one key")
    kept = F.array_compact(F.array(*[F.when(condition(df, p), F.lit(p.key)) for p in picklists]))
    kinds, at = dict(df.dtypes), F.col("__list")
    if numbers is None:
        numbers = numeric_text_columns(df, [o.column for p in picklists for o in p.sort])
    orders = {p.key: [o for o in p.sort if o.column in kinds] for p in picklists}
    keys = {}
    for place in range(max((len(o) for o in orders.values()), default=0)):
        null, number, up, down = F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string")
        for key, order in orders.items():
            if place >= len(order):
                continue
            o, kind, mine = order[place], kinds[order[place].column], at == key
            if kind in NUMERIC or kind == "boolean" or o.column in numbers:
                value = _number(col(o.column), kind)
                number = F.when(mine, value if o.ascending else -value).otherwise(number)
            else:
                value = col(o.column).cast("string")
                up, down = (F.when(mine, value).otherwise(up), down) if o.ascending else (up, F.when(mine, value).otherwise(down))
            null = F.when(mine, value.isNull()).otherwise(null)
        keys |= {f"__n{place}": null, f"__x{place}": number, f"__u{place}": up, f"__d{place}": down}
    spread = df.withColumn("__list", F.explode(kept)).withColumns(keys)
    order = [F.col(k).desc_nulls_last() if k.startswith("__d") else F.col(k).asc_nulls_last() for k in keys] + [col(tie).asc_nulls_last()]
    limits = {p.key: p.limit for p in picklists if p.limit > 0}
    out = None
    if limits:
        own = reduce(lambda c, kv: F.when(at == kv[0], F.lit(kv[1])).otherwise(c), limits.items(), F.lit(0))
        ranked = spread.where(at.isin(list(limits))).withColumn("rank", F.row_number().over(W.partitionBy("__list").orderBy(*order)).cast("long"))
        out = ranked.where(F.col("rank") <= max(limits.values())).where(F.col("rank") <= own)
    if endless := [p.key for p in picklists if p.limit <= 0]:
        placed = stored(numbered(spread.where(at.isin(endless)), [at, *order], "__place"), "endless")
        first = placed.groupBy("__list").agg(F.min("__place").alias("__first"))  # a row for each list
        ranked = placed.join(F.broadcast(first), "__list").withColumn("rank", F.col("__place") - F.col("__first") + 1).drop("__place", "__first")
        out = ranked if out is None else out.unionByName(ranked.select(*[col(c) for c in out.columns]))
    if out is None:
        out = spread.withColumn("rank", F.lit(0).cast("long")).where(F.lit(False))
    return out.select(at.alias("picklist"), "rank", *[col(c) for c in df.columns])


def numeric_text_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Text columns among ``names`` of which every non-null value is a number; one job for all of them."""
    texts = [n for n in names if dict(df.dtypes).get(n) == "string"]
    if not texts:
        return []
    row = df.agg(*[F.coalesce(F.bool_and(col(n).isNull() | col(n).try_cast("double").isNotNull()), F.lit(True)).alias(f"c{i}") for i, n in enumerate(texts)]).first()
    return [n for i, n in enumerate(texts) if row[i]]


def output_columns(columns: list[str], id_name: str, picklist: Picklist, mode: str = "minimal") -> list[str]:
    """What a picklist shows: "minimal", "category" or "all"."""
    if mode == "all":
        return list(columns)
    if picklist.output_columns:
        return [c for c in [id_name, *(c for c in picklist.output_columns if c != id_name)] if c in columns]
    names = [id_name, *(f.column for f in picklist.filters), *(s.column for s in picklist.sort)]
    if mode == "category":
        names = [id_name, *(c for k in picklist.include_categories for c in category_columns(columns, k)), *names[1:]]
    out = [c for c in dict.fromkeys(names) if c in columns]
    for key in picklist.include_categories if mode == "minimal" else ():
        if key not in CATEGORIES:
            continue
        for i, c in enumerate([CATEGORIES[key].key_column, *category_columns(columns, key)]):
            if c in columns and c not in out:
                out.append(c)
            if i and len(out) >= PROJECTION:
                break
    return out


def load_picklists(text: str) -> dict[str, Picklist]:
    """Definitions from JSON (or YAML where the library is installed): a list, or an object by key."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        raw = yaml.safe_load(text)
    entries = raw.get("picklists", raw) if isinstance(raw, dict) else raw
    if isinstance(entries, dict):
        entries = [{"key": k} | v for k, v in entries.items()]
    out = {}
    for e in entries:
        if not e.get("key"):
            raise ValueError("a picklist has no key")
        rules = tuple(Rule(f["column"], f["op"], f.get("value"), f.get("value2"), f.get("missing", "warn_skip")) for f in e.get("filters", ()))
        orders = tuple(Order(s["column"], bool(s.get("ascending", True))) for s in e.get("sort", ()))
        out[e["key"]] = Picklist(e["key"], e.get("name", e["key"]), e.get("description", ""), e.get("logic", "all"), rules, orders, int(e.get("limit") or 0), tuple(e.get("include_categories", ())), tuple(e.get("output_columns", ())))
    return out


def resolve(names: Iterable[str] | None, configured: dict[str, Picklist] | None = None) -> list[Picklist]:
    """The asked definitions; a configured one replaces a built-in of the same key."""
    known = BUILTIN | (configured or {})
    unknown = [n for n in names or () if n not in known]
    if unknown:
        raise ValueError(f"unknown picklists: {', '.join(unknown)}")
    return [known[n] for n in names] if names else list(known.values())
