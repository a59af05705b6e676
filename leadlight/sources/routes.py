"""What a route solver wrote: every layout of its JSON, one row for each target, and the nodes of its route trees.

The JSON stays a VARIANT: nothing needs a schema, and what a solver leaves out is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.sources.storage import numbered, stored

#: Columns of a flattened result and their types; the first is the target's own, html_page is derived.
COLUMNS = {
    "target": "string", "is_solved": "boolean", "top_score": "double", "number_of_routes": "int", "number_of_solved_routes": "int", "search_time": "double", "max_transforms": "int",
    "number_of_steps": "int", "number_of_precursors": "int", "precursors_in_stock": "string", "precursors_not_in_stock": "string",
}


#: Cells of a node; ``odd`` are the values of one that has others than two texts and a truth value.
NODE = {"node": pa.string(), "parent": pa.string(), "depth": pa.int32(), "kind": pa.string(), "smiles": pa.string(), "in_stock": pa.bool_(), "odd": pa.string(), "inner": pa.bool_()}
#: The usual kinds of a node's values.
TEXT, TRUTH = (str, type(None)), (bool, type(None))
#: Nodes that a task holds as Python objects before they leave it.
HELD = 1 << 16


def _parsed(rows: DataFrame, blank: str) -> DataFrame:
    """With ``v``: the one JSON value that the text ``value`` holds, null if it holds another number of them or anything else.

    The parser stops after the first value; within brackets it has to read to the end.
    """
    value = F.trim("value", F.lit(blank))
    ends = F.concat(F.left(value, F.lit(1)), F.right(value, F.lit(1))).isin("{}", "[]")
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))), "$", "array<variant>")
    # a step of its own, so that the text is parsed once
    return rows.withColumn("items", F.when(ends, items)).withColumn("v", F.when(F.size("items") == 1, F.col("items")[0])).drop("items", "value")


def _entries(rows: DataFrame) -> DataFrame:
    """(file, place, item, own, v): the results in each JSON value: of an object with ``data`` those, of an array its items, else itself.

    ``own`` is the row_index that a result says itself. A null value stays as one row without ``read``.
    """
    items = F.coalesce(F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    each = rows.select("file", "place", F.col("v").isNotNull().alias("read"), F.posexplode(items).alias("item", "v"))
    return each.withColumn("own", F.try_variant_get("v", "$.row_index", "long"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """(row_index long, v variant): the results of a file, or of a folder and those below it, in their order, from 0 on.

    A file may hold JSON lines, one array, or one table-oriented object (results under ``data``), on one line or many,
    compressed or not. Lines that are JSON are read as lines, so large files are split; only a file with a line that is none is
    read as a whole. A file that is not JSON then raises an error. Results are numbered by file name and place; one that says
    ``row_index`` itself keeps that number. Every text is parsed once, and only results without a number are joined with one.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("place"), "value")
    kept = stored(_entries(_parsed(text.where(F.trim("value", F.lit(" \t\r")) != ""), " \t\r")), "results")
    whole = [r["file"] for r in kept.where("not read").select("file").distinct().collect()]  # names of files only
    if whole:
        cells = spark.read.text(whole, wholetext=True)
        at = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("line")).alias("place")
        found = _parsed(cells.select(F.col("_metadata.file_path").alias("file"), at, "value"), " \t\r\n")
        sure = found.withColumn("v", F.coalesce("v", F.raise_error(F.concat(F.lit("not JSON: "), "file")).cast("variant")))
        kept = kept.where(~F.col("file").isin(whole)).unionByName(stored(_entries(sure), "results"))
    said = kept.where("own is not null").select(F.col("own").alias("row_index"), "v")
    rest = kept.where("own is null")
    if rest.isEmpty():
        return said
    # a variant can't be sorted or shuffled by, so only places are numbered
    places = numbered(kept.select("file", "place", "item"), [F.col("file"), F.col("place"), F.col("item")], "row")
    return said.unionByName(rest.join(places, ["file", "place", "item"]).select(F.col("row").alias("row_index"), "v"))


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NODE of every tree (row_index, route, json): a node, then its children, whatever the depth."""
    for batch in batches:
        found: list[tuple] = []
        for i, text in enumerate(batch.column(2).to_pylist()):
            open_nodes = [] if text is None else [(json.loads(text), "0", None, 0)]
            while open_nodes:
                node, name, parent, depth = open_nodes.pop()
                held = node if type(node) is dict else {}
                kind, smiles, in_stock, below = held.get("type"), held.get("smiles"), held.get("in_stock"), held.get("children")
                below = below if type(below) is list else ()
                if type(kind) in TEXT and type(smiles) in TEXT and type(in_stock) in TRUTH:
                    found.append((i, name, parent, depth, kind, smiles, in_stock, None, bool(below)))
                else:
                    found.append((i, name, parent, depth, None, None, None, json.dumps({"type": kind, "smiles": smiles, "in_stock": in_stock}), bool(below)))
                if below:
                    open_nodes += [(child, f"{name}.{j}", name, depth + 1) for j, child in enumerate(below)]
            if len(found) >= HELD:
                yield _cells(batch, found)
                found = []
        if found:
            yield _cells(batch, found)


def _cells(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    at, *cells = zip(*found, strict=True)
    kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(2)]
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cells, NODE.values(), strict=True)]], ["row_index", "route", *NODE])


#: What a tree counts; ``odd`` are the leaves of one that has others than texts and truth values.
COUNTS = {"steps": pa.int32(), "precursors": pa.int32(), "in_stock": pa.string(), "not_in_stock": pa.string(), "odd": pa.string()}


def _tree_counts(text: str) -> dict[str, object]:
    """COUNTS of one tree: reactions, leaves, and the leaves' texts from left to right."""
    open_nodes, steps, leaves, odd = [json.loads(text)], 0, [], False
    while open_nodes:
        node = open_nodes.pop()
        held = node if type(node) is dict else {}
        kind, below = held.get("type"), held.get("children")
        steps += kind == "reaction"
        if type(below) is list and below:
            open_nodes += reversed(below)
        elif kind != "reaction":
            smiles, in_stock = held.get("smiles"), held.get("in_stock")
            odd |= type(smiles) not in TEXT or type(in_stock) not in TRUTH
            leaves.append((smiles, in_stock))
    if odd:
        return {"steps": steps, "precursors": len(leaves), "odd": json.dumps([{"smiles": s, "in_stock": k} for s, k in leaves])}
    yes, no = (", ".join([s for s, k in leaves if s is not None and bool(k) == stocked]) for stocked in (True, False))
    return {"steps": steps, "precursors": len(leaves), "in_stock": yes, "not_in_stock": no}


def tree_counts(text: Column) -> Column:
    """A struct (steps, precursors int, in_stock, not_in_stock string) of a tree's JSON text, null for null; see ``counted_routes``.

    A tree is counted where it lies: no node becomes a row, nothing is shuffled, and columns beside it stay where they are.
    """

    @F.arrow_udf("steps int, precursors int, in_stock string, not_in_stock string, odd string")
    def counted(texts: pa.Array) -> pa.Array:
        found = [None if s is None else _tree_counts(s) for s in texts.to_pylist()]
        return pa.array(found, pa.struct(list(COUNTS.items())))

    return counted.asNondeterministic()(text)  # or a filter on the result would count every tree a second time


def _plain_counts(c: Column) -> list[Column]:
    """The four counts of a ``tree_counts``; leaves that are not of their usual kind are cast as a variant is."""
    leaves = F.try_variant_get(F.parse_json(c["odd"]), "$", "array<variant>")
    stocked = lambda x: F.coalesce(F.try_variant_get(x, "$.in_stock", "boolean"), F.lit(False))
    texts = lambda kept: F.concat_ws(", ", F.transform(F.filter(leaves, kept), lambda x: F.try_variant_get(x, "$.smiles", "string")))
    of = lambda name, kept: F.coalesce(c[name], F.when(c["odd"].isNotNull(), texts(kept))).alias(name)
    return [c["steps"].alias("steps"), c["precursors"].alias("precursors"), of("in_stock", stocked), of("not_in_stock", lambda x: ~stocked(x))]


def route_counts(routes: DataFrame) -> DataFrame:
    """(row_index, route, steps, precursors int, in_stock, not_in_stock string) of every route tree, as ``counted_routes`` of its nodes, in one narrow stage."""
    return _trees(routes).withColumn("c", tree_counts(F.col("json"))).where("c is not null").select("row_index", "route", *_plain_counts(F.col("c")))


def _texts(rows: DataFrame, tree: str) -> DataFrame:
    """With ``json``: the text of a tree, which is an object or a JSON text itself; null if it is neither.

    Only what is written as a text is looked at again, and each is written once (a filter on ``json`` would write it twice).
    """
    inner = F.to_json(F.try_parse_json(F.col(tree).cast("string")))
    return rows.withColumn("text", F.to_json(tree)).withColumn("json", F.when(F.startswith("text", F.lit('"')), inner).otherwise(F.col("text"))).drop("text")


def _trees(routes: DataFrame) -> DataFrame:
    """(row_index, route, json) of every tree."""
    each = routes.select(F.col("row_index").cast("long"), F.posexplode(F.try_variant_get("v", "$.trees", "array<variant>")).alias("route", "tree"))
    return _texts(each, "tree").drop("tree")


def walked(routes: DataFrame) -> DataFrame:
    """The nodes of ``route_nodes`` with ``inner`` (a node has children).

    One narrow stage unfolds each tree where it lies; depth is not bounded, nothing is shuffled or written.
    """
    nodes = _trees(routes).mapInArrow(_unfolded, "row_index long, route int, node string, parent string, depth int, kind string, smiles string, in_stock boolean, odd string, inner boolean")
    # a value that is not of its usual kind is cast as a variant is
    cast = lambda name, path, kind: F.coalesce(name, F.when(F.col("odd").isNotNull(), F.try_variant_get(F.parse_json("odd"), path, kind))).alias(name)
    return nodes.select("row_index", "route", "node", "parent", "depth", cast("kind", "$.type", "string"), cast("smiles", "$.smiles", "string"), cast("in_stock", "$.in_stock", "boolean"), "inner")


def route_nodes(routes: DataFrame) -> DataFrame:
    """(row_index, route, node, parent string, depth int, kind, smiles string, in_stock boolean) of every node of every route tree.

    Trees stand under ``trees`` as objects or as JSON texts, routes count from 0; a node's name is its parent's and its place among
    the children.
    """
    return walked(routes).drop("inner")


def counted_routes(nodes: DataFrame) -> DataFrame:
    """(row_index, route, steps, precursors int, in_stock, not_in_stock string): reactions, leaves, and the leaves' texts.

    A leaf is a molecule without children; texts come in the order of their node names, joined by ", ". Nodes without ``inner``
    are joined with their parents first.
    """
    if "inner" not in nodes.columns:
        parents = nodes.where("parent is not null").select("row_index", "route", F.col("parent").alias("node")).distinct()
        nodes = nodes.join(parents.withColumn("inner", F.lit(True)), ["row_index", "route", "node"], "left")
    leaf = nodes.withColumn("leaf", ~F.coalesce("inner", F.lit(False)) & (F.coalesce("kind", F.lit("mol")) != "reaction"))
    listed = lambda stocked: F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.when(F.col("leaf") & (F.coalesce("in_stock", F.lit(False)) == stocked), F.struct(F.transform(F.split("node", "\\."), lambda x: x.cast("int")).alias("order"), "smiles")))), lambda x: x["smiles"]))
    return leaf.groupBy("row_index", "route").agg(F.count_if(F.col("kind") == "reaction").cast("int").alias("steps"), F.count_if("leaf").cast("int").alias("precursors"), listed(True).alias("in_stock"), listed(False).alias("not_in_stock"))


def flatten_solved(targets: DataFrame, routes: DataFrame, n_routes: int = 5, index: str = "row_index", ident: str = "Compound_ID") -> DataFrame:
    """One row for each target, joined by row number: its id, COLUMNS, html_page, n_routes_exported and routes_json (the first trees).

    Steps and precursors that the solver left out are counted in the target's first route. A target without a result has nulls.
    """
    said = lambda name: F.try_variant_get("v", f"$.{name}", COLUMNS[name])
    first = F.try_variant_get("v", "$.trees[0]", "variant")
    short = said("number_of_steps").isNull() | said("number_of_precursors").isNull()
    known = _texts(routes.withColumn("first", F.when(short, first)), "first").withColumn("c", tree_counts(F.col("json"))).select("row_index", "v", F.struct(*_plain_counts(F.col("c"))).alias("c"))
    counted = {"number_of_steps": "steps", "number_of_precursors": "precursors", "precursors_in_stock": "in_stock", "precursors_not_in_stock": "not_in_stock"}
    cells = [(F.coalesce(said(name), F.col("c")[counted[name]]) if name in counted else said(name)).alias(name) for name in COLUMNS]
    trees = F.slice(F.coalesce(F.try_variant_get("v", "$.trees", "array<variant>"), F.array().cast("array<variant>")), 1, n_routes)
    full = known.select(F.col("row_index"), *cells, F.size(trees).alias("n_routes_exported"), F.concat(F.lit("["), F.array_join(F.transform(trees, lambda t: F.to_json(t)), ","), F.lit("]")).alias("routes_json"))
    safe = F.substring(F.trim(F.regexp_replace(col(ident).cast("string"), r"[^\p{L}\p{N}._-]", "_"), F.lit("_")), 1, 80)
    page = F.concat(F.lit("targets/"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("compound")), F.lit(".html"))
    out = targets.select(col(index).alias("row_index"), col(ident)).join(full, "row_index", "left")
    return out.withColumns({"html_page": page, "n_routes_exported": F.coalesce("n_routes_exported", F.lit(0)), "routes_json": F.coalesce("routes_json", F.lit("[]"))})
