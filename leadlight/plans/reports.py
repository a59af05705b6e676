"""Compositions over compound tables: category listings and texts, picklist runs, whole reports, compare columns."""

from __future__ import annotations

import html
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.operators.analyze import NUMERIC, numeric_summary, profile, rates, top_rows, value_counts, value_counts_of
from leadlight.operators.picklists import Picklist, output_columns, run_together
from leadlight.plans.categories import CATEGORIES, SMILES_COLUMNS, category_columns, category_key, id_column
from leadlight.sources.storage import stored, write_text
from leadlight.sources.tables import metadata

#: Rows of a table in a page, similarity columns of a report.
PAGE_ROWS, SIM_COLUMNS = 1000, 8


def present_categories(columns: list[str]) -> list[tuple[str, str, int]]:
    """(key, title, number of columns) of the categories of which a table has columns."""
    return [(k, c.title, len(found)) for k, c in CATEGORIES.items() if (found := category_columns(columns, k))]


def compare_columns(columns: list[str]) -> dict[str, str | None]:
    """The structure columns that a comparison shows (input, prepared, calc_base, calc, protomer).

    What is missing falls back: input to SMILES, the two calculated ones to each other, all to the best structure column.
    A protomer has no fallback.
    """
    have = set(columns)
    best = next((c for c in SMILES_COLUMNS if c in have), None)
    first = lambda *names: next((n for n in names if n in have), best)
    return {
        "input": first("Input_Canonical_SMILES", "SMILES"),
        "prepared": first("Canonical_SMILES"),
        "calc_base": first("Calc_Base_SMILES", "Calc_Canonical_SMILES"),
        "calc": first("Calc_Canonical_SMILES", "Calc_Base_SMILES"),
        "protomer": "Protomer_Selected_SMILES" if "Protomer_Selected_SMILES" in have else None,
    }


def _cell(x: object) -> str:
    return "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def _markdown(columns: list[str], rows: list) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(x).replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in rows])


def markdown_table(df: DataFrame, limit: int = PAGE_ROWS) -> str:
    """The first rows as a Markdown table."""
    return _markdown(df.columns, df.limit(limit).collect())


def html_page(rows: list, columns: list[str], title: str, notes: list[str] | None = None) -> str:
    """A page with one table, and a list of warnings before it where there are any."""
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(_cell(x))}</{tag}>" for x in cells) + "</tr>"
    body = "\n".join([row(columns, "th"), *(row(r, "td") for r in rows)])
    warned = '<ul class="warnings">' + "".join(f"<li>{html.escape(n)}</li>" for n in notes) + "</ul>\n" if notes else ""
    return f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body><h1>{html.escape(title)}</h1>\n{warned}<table>\n{body}\n</table></body></html>\n'


def html_table(df: DataFrame, title: str, limit: int = PAGE_ROWS) -> str:
    """The first rows as a page with one table."""
    return html_page(df.limit(limit).collect(), df.columns, title)


def category_text(df: DataFrame, key: str, numeric_bool: bool = False) -> str:
    """A category's summary as text: its key column's numbers or counts; ``numeric_bool`` takes flags as 1 and 0."""
    column = category_key(df, key)
    if column is None:
        return f"{CATEGORIES[key].title}: no columns\n"
    kind = dict(df.dtypes)[column]
    part = numeric_summary(df, [column]) if kind in NUMERIC or kind == "boolean" and numeric_bool else value_counts(df, column)
    return f"## {CATEGORIES[key].title}\n\n{markdown_table(part)}\n"


def run_picklists(df: DataFrame, picklists: list[Picklist], folder: str, mode: str = "minimal", fmt: str = "csv", parameters: dict[str, object] | None = None) -> dict[str, str]:
    """Each picklist written below ``folder``, with a page and one sidecar of parameters: {key: path}.

    One scan keeps and ranks the rows of all lists, one write puts them into a folder for each; a table holds the columns of
    all lists, a page its own. Pages (<key>.html, the first PAGE_ROWS rows and the warnings of missing columns) and metadata.json are
    files below ``folder``, and rows of ``pages`` as well. Ids settle ties.
    """
    spark, ident = df.sparkSession, id_column(df.columns)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        every = stored(run_together(df, picklists, ident), "picklists")
    shown = {p.key: output_columns(df.columns, ident, p, mode) for p in picklists}
    missing = {p.key: sorted({f.column for f in p.filters if f.column not in df.columns}) for p in picklists}
    union = list(dict.fromkeys(c for columns in shown.values() for c in columns))
    tables = f"{folder}/lists"
    writer = every.select("picklist", "rank", *[col(c) for c in union]).repartitionByRange("picklist", "rank").sortWithinPartitions("picklist", "rank").drop("rank").write.mode("overwrite").partitionBy("picklist")
    if fmt == "parquet":
        writer.parquet(tables)
    else:
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"').csv(tables)
    first: dict[str, list] = {p.key: [] for p in picklists}
    for r in every.where(F.col("rank") <= PAGE_ROWS).orderBy("picklist", "rank").collect():
        first[r["picklist"]].append(r)
    counts = {r["picklist"]: r["count"] for r in every.groupBy("picklist").count().collect()}
    pages = {f"{p.key}.html": html_page([[r[c] for c in shown[p.key]] for r in first[p.key]], shown[p.key], p.name, [f"missing column: {c}" for c in missing[p.key]]) for p in picklists}
    facts = {"picklists": [p.key for p in picklists], "mode": mode, "rows": {p.key: counts.get(p.key, 0) for p in picklists}, "warnings": sorted({str(w.message) for w in caught})}
    pages["metadata.json"] = metadata(spark, "picklists", [], facts | (parameters or {}))
    for name, text in pages.items():
        write_text(spark, f"{folder}/{name}", text)
    spark.createDataFrame(list(pages.items()), "name string, text string").write.mode("overwrite").parquet(f"{folder}/pages")
    return {p.key: f"{tables}/picklist={p.key}" for p in picklists}


def build_report(df: DataFrame, title: str = "Report", top: int = 10) -> str:
    """A Markdown report: an overview, then for every present category its key column's summary, distribution and first rows.

    The key columns are stored once. Summaries, flags, distributions and first rows are one job or two for all categories together.
    Similarity columns (Sim_..., the first 8 by name) have a section of their own with their summaries.
    """
    ident = id_column(df.columns)
    keys = {k: category_key(df, k) for k, _, _ in present_categories(df.columns)}
    kinds = dict(df.dtypes)
    similar = [c for c in sorted(df.columns) if c.startswith("Sim_") and kinds[c] in NUMERIC][:SIM_COLUMNS]
    names = list(dict.fromkeys([ident, *keys.values(), *similar]))
    table = stored(df.select(*[col(c) for c in names]), "report")
    chosen = list(dict.fromkeys(keys.values()))
    numbers = [c for c in names[1:] if kinds[c] in NUMERIC]
    flags = [c for c in chosen if kinds[c] == "boolean"]
    summary = {r["column"]: r for r in numeric_summary(table, numbers).collect()} if numbers else {}
    share = {r["name"]: r for r in rates(table, {c: col(c) for c in flags}).collect()} if flags else {}
    histograms, bars = profile(table, [c for c in chosen if c in numbers], [c for c in chosen if c not in numbers], 10)
    bins, counts, rows = {}, {}, {}
    for r in histograms.orderBy("column", "bin").collect():
        bins.setdefault(r["column"], []).append(r[1:])
    for r in bars.orderBy("column", "place").collect():
        counts.setdefault(r["column"], []).append(r[2:])
    for r in top_rows(table, chosen, bars, ident, top).orderBy("column", "place").collect() if chosen else ():
        rows.setdefault(r["column"], []).append(r)
    facts = lambda r: f"n {r['n']}, mean {_cell(r['mean'])}, median {_cell(r['median'])}, {_cell(r['min'])} to {_cell(r['max'])}, deviation {_cell(r['std'])}"
    lines = [f"# {title}", "", f"{table.count()} compounds, {len(keys)} categories.", ""]
    for key, column in keys.items():
        lines += [f"## {CATEGORIES[key].title}", ""]
        if column in summary:
            lines += [f"{column}: {facts(summary[column])}", "", _markdown(["bin", "low", "high", "n"], bins.get(column, []))]
        else:
            if column in share:
                lines.append(f"{column}: {share[column]['hits']} of {share[column]['n']}\n")
            lines.append(_markdown(["value", "n"], counts.get(column, [])))
        shown = [[r["id"]] if column == ident else [r["id"], r["value"]] for r in rows.get(column, [])]
        lines += ["", _markdown(list(dict.fromkeys([ident, column])), shown), ""]
    if similar:
        lines += ["## Similarity", "", *[f"{c}: {facts(summary[c])}" for c in similar], ""]
    return "\n".join(lines)


def combined_text(df: DataFrame, dataset: str, top: int = 5, values: int = 50) -> str:
    """All categories that a table has, as one text: numbers with their first rows, classes with counts and shares of all rows.

    The jobs are those of one summary, one count of all classes and one ranking, whatever the number of categories. Of a class
    column the ``values`` commonest are listed, and how many others there are.
    """
    ident = id_column(df.columns)
    keys = {k: category_key(df, k) for k, _, _ in present_categories(df.columns)}
    chosen = list(dict.fromkeys(keys.values()))
    table = stored(df.select(*[col(c) for c in dict.fromkeys([ident, *chosen])]), "combined")
    kinds = dict(table.dtypes)
    numbers, classes = [c for c in chosen if kinds[c] in NUMERIC], [c for c in chosen if kinds[c] not in NUMERIC]
    summary = {r["column"]: r for r in numeric_summary(table, numbers).collect()} if numbers else {}
    first, counted, others = {}, {}, {}
    if numbers:
        _, none = profile(table, [], [], 1)
        for r in top_rows(table, numbers, none, ident, top).orderBy("column", "place").collect():
            first.setdefault(r["column"], []).append(r)
    if classes:
        place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
        counts = stored(value_counts_of(table, classes).withColumn("place", place), "counts")
        for r in counts.where(F.col("place") <= values).orderBy("column", "place").collect():
            counted.setdefault(r["column"], []).append(r)
        others = {r["column"]: r["n"] for r in counts.where(F.col("place") > values).groupBy("column").agg(F.count("*").alias("n")).collect()}
    lines = [f"dataset: {dataset}", f"compounds: {table.count()}", f"columns: {len(df.columns)}"]
    for key, column in keys.items():
        lines += ["", f"{CATEGORIES[key].title} ({key})"]
        if column in summary:
            r = summary[column]
            if r["n"]:
                lines.append(f"{column}: " + ", ".join(f"{k}={r[k]:.3f}" for k in ("mean", "median", "min", "max")))
                lines += [f"  {x['id']} | {column}={x['value']}" for x in first.get(column, ()) if x["value"] is not None]
        else:
            lines += [f"{column}={r['value']}: {r['n']} ({r['pct']:.1f}%)" for r in counted.get(column, ())]
            lines += [f"{column}: {others[column]} other values"] if column in others else []
    return "\n".join(lines) + "\n"


def ragged_union(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def cluster_sizes(clusters: DataFrame, n: int = 10, key: str = "Cluster_ID") -> DataFrame:
    """(Cluster_ID, Cluster_Size) of the largest clusters, equal ones by id."""
    return clusters.where(col(key).isNotNull()).groupBy(col(key)).agg(F.count("*").alias("Cluster_Size")).orderBy(F.desc("Cluster_Size"), key).limit(n)


