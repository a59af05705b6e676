"""Summaries of compound tables: distributions, rates, prevalence, rankings, histograms, and the category analyses.

What needs one pass takes one: all numeric summaries of a table are one aggregation, all alert counts another.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.functions.rules import col, yes
from leadlight.operators.selection import medians
from leadlight.plans.categories import id_column
from leadlight.sources.storage import stored

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def _plain(df: DataFrame, name: str) -> Column:
    c = col(name)
    return F.nanvl(c, F.lit(None)) if dict(df.dtypes)[name] in ("double", "float") else c


def unpivoted(df: DataFrame, keys: list[str], columns: Iterable[str], name: str = "column", value: str = "value") -> DataFrame:
    """Long form (keys, column, value as double), nulls and NaN left as null."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.nanvl(_plain(df, c).cast("double"), F.lit(None)).alias(value)) for c in columns])
    return df.select(*[col(k) for k in keys], F.explode(cells).alias("cell")).select(*[col(k) for k in keys], f"cell.{name}", f"cell.{value}")


def numeric_summary(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, n, mean, median, min, max, std) of each column, over what is not null. Booleans count as 1 and 0.

    One aggregation for all columns, and a pass or a few for the exact medians, see ``medians``.
    """
    names = list(columns)
    aggs = []
    for i, c in enumerate(names):
        x = _plain(df, c).cast("double")
        for k, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp)):
            aggs.append(f(x).alias(f"c{i}_{k}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"c{i}_{k}").alias(k) for k in ("n", "mean", "min", "max", "std")]) for i, c in enumerate(names)])
    middle = medians(unpivoted(df, [], names), ["column"])  # a row for each column
    return one.select(F.inline(rows)).join(F.broadcast(middle), "column", "left").select("column", "n", "mean", "median", "min", "max", "std")


def value_counts(df: DataFrame, column: str, by_value: bool = False) -> DataFrame:
    """(value, n, pct) with nulls as a value and percentages of all rows; largest count first, or by value."""
    counts = df.groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    out = counts.join(F.broadcast(total)).withColumn("pct", 100 * F.col("n") / F.col("__total")).drop("__total")
    return out.orderBy("value") if by_value else out.orderBy(F.desc("n"), "value")


def value_counts_of(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value as text, n, pct) of several columns in one pass; otherwise as ``value_counts``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("__total"))  # a row for each column
    return counts.join(F.broadcast(totals), "column").select("column", "value", "n", (100 * F.col("n") / F.col("__total")).alias("pct"))


def rates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(name, hits, n, rate) of each condition; null is no hit but stays in n. One aggregation."""
    aggs = [F.count_if(yes(c)).alias(f"c{i}") for i, c in enumerate(conditions.values())]
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"c{i}").alias("hits"), F.col("n"), F.try_divide(F.col(f"c{i}").cast("double"), F.col("n")).alias("rate")) for i, name in enumerate(conditions)])
    return df.agg(F.count("*").alias("n"), *aggs).select(F.inline(rows))


def prevalence(df: DataFrame, columns: Iterable[str], limit: int = 25) -> DataFrame:
    """(alert, n) of the columns that are above 0, or true, in some row; the commonest first."""
    kinds = dict(df.dtypes)
    hit = lambda c: col(c) if kinds[c] == "boolean" else _plain(df, c) > 0
    names = [c for c in columns if kinds[c] in (*NUMERIC, "boolean")]
    found = rates(df, {c: hit(c) for c in names}) if names else df.sparkSession.createDataFrame([], "name string, hits long")
    return found.where("hits > 0").select(F.col("name").alias("alert"), F.col("hits").alias("n")).orderBy(F.desc("n"), "alert").limit(limit)


def top_n(df: DataFrame, keys: Iterable[tuple[str, bool]], n: int = 20, tie: str | None = None) -> DataFrame:
    """The first n rows by (column, descending) keys, nulls and NaN last, then by ``tie`` (the id column by default)."""
    order = [_plain(df, c).desc_nulls_last() if down else _plain(df, c).asc_nulls_last() for c, down in keys]
    return df.orderBy(*order, col(tie or id_column(df.columns))).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value; the last one is closed. Empty bins stay.

    If all values are equal, one bin of width 1 around them holds them all.
    """
    x = F.nanvl(_plain(df, column).cast("double"), F.lit(None))
    values = stored(df.select(x.alias("x")).where("x is not null"), "histogram")  # what leads to the column runs once
    edges = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo is not null")
    edges = edges.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = values.join(F.broadcast(edges)).select(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    grid = edges.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def category_bars(df: DataFrame, column: str, limit: int = 12) -> DataFrame:
    """(value, n) of the commonest values, null as "(missing)"."""
    value = F.coalesce(col(column).cast("string"), F.lit("(missing)")).alias("value")
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def top_table(df: DataFrame, key: str, id_name: str, n: int = 10) -> DataFrame:
    """A report's first rows: a number descending; a class with its commonest value first, then by class and id."""
    if dict(df.dtypes)[key] in NUMERIC:
        return df.orderBy(_plain(df, key).desc_nulls_last(), col(id_name)).limit(n)
    mode = df.where(col(key).isNotNull()).groupBy(col(key).alias("mode")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mode").limit(1).select("mode")
    marked = df.join(F.broadcast(mode), how="left")
    first = F.coalesce(col(key) == F.col("mode"), F.lit(False))
    return marked.orderBy(first.desc(), col(key).asc_nulls_last(), col(id_name)).limit(n).drop("mode")


# ---- the profile of a report ----------------------------------------------------------------------


def profile(df: DataFrame, numbers: list[str], classes: list[str], bins: int = 30, bars: int = 12) -> tuple[DataFrame, DataFrame]:
    """Histograms (column, bin, low, high, n) of all numeric columns, and bars (column, place, value, n) of all others.

    Two passes whatever the number of columns: the extremes of all, then bins and values as cells of one aggregation. Bins and
    bars are those of ``histogram`` and ``category_bars``; a column without values has no bins. What is collected are two numbers a
    column.
    """
    spark, value = df.sparkSession, lambda c: F.nanvl(_plain(df, c).cast("double"), F.lit(None))
    ends = df.agg(*[f(value(c)) for c in numbers for f in (F.min, F.max)]).first() if numbers else ()
    spans = {}
    for i, c in enumerate(numbers):
        lo, hi = ends[2 * i], ends[2 * i + 1]
        if lo is not None:
            spans[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    width = lambda c: (spans[c][1] - spans[c][0]) / bins
    place = lambda c: F.when(value(c).isNotNull(), F.least(F.floor((value(c) - spans[c][0]) / width(c)), F.lit(bins - 1))).cast("int")
    cells = [F.struct(F.lit(c).alias("column"), place(c).alias("bin"), F.lit(None).cast("string").alias("value")) for c in spans]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("int").alias("bin"), F.coalesce(col(c).cast("string"), F.lit("(missing)")).alias("value")) for c in classes]
    none = spark.createDataFrame([], "column string, bin int, value string, n long")
    counts = stored(df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.column", "c.bin", "c.value").agg(F.count("*").alias("n")), "profile") if cells else none
    grid = [(c, i, spans[c][0] + i * width(c), spans[c][0] + (i + 1) * width(c)) for c in spans for i in range(bins)]
    full = F.broadcast(spark.createDataFrame(grid, "column string, bin int, low double, high double"))
    histograms = full.join(counts.where("bin is not null").select("column", "bin", "n"), ["column", "bin"], "left").select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    ranked = counts.where("value is not null").withColumn("place", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value")))
    return histograms, ranked.where(F.col("place") <= bars).select("column", "place", "value", "n")


def top_rows(df: DataFrame, columns: list[str], bars: DataFrame, id_name: str, n: int = 10) -> DataFrame:
    """(column, place, id, value) of the first rows by each column, as ``top_table``, in one pass; ``bars`` say which class is commonest."""
    kinds = dict(df.dtypes)
    modes = {r["column"]: r["value"] for r in bars.where("value <> '(missing)'").groupBy("column").agg(F.min_by("value", "place").alias("value")).collect()}
    cells = []
    for c in columns:
        number = _plain(df, c).cast("double") if kinds[c] in NUMERIC else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if kinds[c] in NUMERIC else col(c).cast("string")
        late = F.coalesce(text != modes.get(c), F.lit(True)) if c in modes else F.lit(False)
        cells.append(F.struct(F.lit(c).alias("column"), late.alias("late"), number.alias("number"), text.alias("text"), col(c).cast("string").alias("value")))
    spread = df.select(col(id_name).alias("id"), F.explode(F.array(*cells)).alias("c")).select("id", "c.*")
    order = W.partitionBy("column").orderBy("late", F.desc_nulls_last("number"), F.asc_nulls_last("text"), "id")
    return spread.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("column", "place", "id", "value")


# ---- the category analyses ------------------------------------------------------------------------


@dataclass(frozen=True)
class Analysis:
    """What one category shows: columns besides the id, and which summaries of which of them."""

    context: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    counts_by_value: bool = False
    flags: tuple[str, ...] = ()
    prevalence: str | None = None
    screen: str | None = None
    top: tuple[tuple[str, bool], ...] = ()


CORE = ("MolWt", "LogP", "TPSA")
ANALYSES: dict[str, Analysis] = {
    "cns_mpo": Analysis(("CNS_MPO", "CNS_MPO_Class", "BBB_Likely", "MPO_MW", "MPO_LogP", "MPO_LogD", "MPO_TPSA", "MPO_HBD", "MPO_pKa", *CORE, "HBD", "cLogD_7.4", "pKa_Basic"), numeric=("CNS_MPO",), counts=("CNS_MPO_Class",), flags=("BBB_Likely",), top=(("CNS_MPO", True),)),
    "oral_bioavailability": Analysis(("Bioavail_Score", "Veber_Pass", "Egan_Pass", "Ghose_Pass", "Muegge_Pass", "RO5_Pass", *CORE, "RotBonds"), numeric=("Bioavail_Score",), flags=("Veber_Pass", "Egan_Pass", "Ghose_Pass", "Muegge_Pass"), top=(("Bioavail_Score", True),)),
    "rule_of_5": Analysis(("RO5_Pass", "RO5_Violations", *CORE, "HBD", "HBA"), counts=("RO5_Violations",), counts_by_value=True, flags=("RO5_Pass",), top=(("RO5_Violations", True),)),
    "rule_of_3": Analysis(("RO3_Pass", "RO3_Violations", *CORE, "HBD", "HBA", "RotBonds"), counts=("RO3_Violations",), counts_by_value=True, flags=("RO3_Pass",), top=(("RO3_Violations", True),)),
    "medchem_flags": Analysis(("PAINS", "PAINS_Type", "BRENK", "NIH", "ZINC", "MedChem_Alerts"), counts=("MedChem_Alerts",), counts_by_value=True, flags=("PAINS", "BRENK", "NIH", "ZINC"), screen="coalesce(MedChem_Alerts, 0) = 0"),
    "toxicity": Analysis(("Tox_Risk", "Tox_Total_Alerts", *CORE), ("Tox_",), numeric=("Tox_Total_Alerts",), counts=("Tox_Risk",), prevalence="Tox_", screen="lower(Tox_Risk) = 'high'"),
    "metabolism": Analysis(("Met_Stability", "Met_Total_Sites", *CORE), ("Met_",), numeric=("Met_Total_Sites",), counts=("Met_Stability",), prevalence="Met_", top=(("Met_Total_Sites", False),)),
    "herg": Analysis(("hERG_Risk", "hERG_Alerts", *CORE), ("hERG_",), numeric=("hERG_Alerts",), counts=("hERG_Risk",), screen="lower(hERG_Risk) = 'high'"),
    "cyp": Analysis(("CYP_Total_Inhibition", *CORE), ("CYP",), counts=("CYP_Total_Inhibition",), counts_by_value=True, flags=("CYP3A4_Inhibitor", "CYP2D6_Inhibitor", "CYP2C9_Inhibitor", "CYP_MBI_Risk"), screen="coalesce(CYP_Total_Inhibition, 0) >= 2"),
    "solubility": Analysis(CORE, ("Sol_",), numeric=("Sol_ESOL_LogS",), counts=("Sol_ESOL_Class",), top=(("Sol_ESOL_LogS", False),)),
    "permeability": Analysis((*CORE, "HBD", "HBA", "BBB_Likely"), ("Perm_",), numeric=("Perm_Caco2_LogPapp",), counts=("Perm_GI_Absorption", "Perm_Pgp_Likelihood"), screen="lower(Perm_GI_Absorption) = 'high' and lower(Perm_Pgp_Likelihood) in ('low', 'medium')"),
    "pk": Analysis(CORE, ("PPB_", "Vd_", "CL_", "T_half", "F_"), counts=("PPB_Class", "Vd_Class", "CL_Risk", "F_Class"), screen="lower(CL_Risk) = 'low'"),
    "lead": Analysis((*CORE, "HeavyAtoms"), ("Lead_",), numeric=("Lead_LE", "Lead_LLE"), counts=("Lead_LE_Quality", "Lead_LLE_Quality"), top=(("Lead_LLE", True), ("Lead_LE", True))),
    "qed": Analysis(("QED", *CORE), ("QED",), numeric=("QED",), screen="QED < 0.4", top=(("QED", True),)),
    "sa_complexity": Analysis(("SA_Score", "SA_Class", *CORE), ("Complexity_",), numeric=("SA_Score",), counts=("SA_Class",), screen="SA_Score >= 6", top=(("SA_Score", True),)),
    "developability": Analysis(CORE, ("Dev_",), numeric=("Dev_Score", "Dev_Risk_Burden"), counts=("Dev_Class", "Dev_Risk_Class"), flags=("Dev_GSK_4_400_Pass", "Dev_Pfizer_3_75_Pass", "Dev_GoldenTriangle_Pass"), top=(("Dev_Score", True), ("Dev_Risk_Burden", False))),
}


def projection(df: DataFrame, key: str) -> DataFrame:
    """The id, SMILES and the analysis's columns, as far as the table has them."""
    a, ident = ANALYSES[key], id_column(df.columns)
    found = [c for c in df.columns if any(c.startswith(p) for p in a.prefixes)]
    names = dict.fromkeys([ident, "SMILES", *a.context, *found])
    return df.select(*[col(c) for c in names if c in df.columns])


def analyze(df: DataFrame, key: str, n: int = 20, summarized: bool = True) -> dict[str, DataFrame]:
    """The parts of a category's analysis, by name; parts whose columns are missing are left out.

    All but the summary, whose medians take jobs of their own, are lazy; ``summarized`` False leaves it out.
    """
    a, have = ANALYSES[key], set(df.columns)
    rows = projection(df, key)
    out = {"table": rows}
    if numeric := [c for c in a.numeric if c in have and summarized]:
        out["summary"] = numeric_summary(rows, numeric)
    for c in a.counts:
        if c in have:
            out[f"counts_{c}"] = value_counts(rows, c, a.counts_by_value)
    if flags := {c: col(c) for c in a.flags if c in have}:
        out["rates"] = rates(rows, flags)
    if a.prevalence:
        totals = {f"{a.prevalence}Total_Alerts", f"{a.prevalence}Total_Sites"}
        out["prevalence"] = prevalence(rows, [c for c in rows.columns if c.startswith(a.prevalence) and c not in totals])
    if a.screen and all(c in have for c in _names(a.screen)):
        out["screen"] = rows.where(a.screen)
    if a.top and all(c in have for c, _ in a.top):
        out["top"] = top_n(rows, a.top, n)
    return out


def _names(condition: str) -> list[str]:
    words = "".join(c if c.isalnum() or c == "_" else " " for c in condition).split()
    return [w for w in words if any(w.startswith(p) for p in ("MedChem", "Tox_", "hERG_", "CYP_", "Perm_", "CL_", "QED", "SA_"))]
