"""Solver output of every layout, and route trees."""

import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from leadlight.sources import routes
from leadlight.sources.routes import counted_routes, flatten_solved, read_routes, route_nodes

LEAF = {"type": "mol", "smiles": "B", "in_stock": True}
TREE = {"type": "mol", "smiles": "A", "in_stock": False, "children": [{"type": "reaction", "children": [LEAF, {"type": "mol", "smiles": "C", "in_stock": False, "children": [{"type": "reaction", "children": [{"type": "mol", "smiles": "D"}]}]}]}]}
RESULTS = [{"index": i, "target": f"T{i}", "is_solved": i % 2 == 0, "top_score": i / 4, "number_of_routes": i, "trees": [TREE] * i, "more": {"x": [1]}} for i in range(5)]


def rows(df):
    return sorted((r["row_index"], json.loads(r["j"])["target"]) for r in df.select("row_index", F.to_json("v").alias("j")).collect())


@pytest.mark.parametrize("layout", ["lines", "array", "table", "pretty array", "pretty table", "zipped table", "zipped lines"])
def test_every_layout_has_the_same_rows(spark, tmp_path, layout):
    table = {"schema": {"fields": [{"name": "index"}]}, "data": RESULTS}
    text = {"lines": "\n".join(map(json.dumps, RESULTS)) + "\n\n", "array": json.dumps(RESULTS), "table": json.dumps(table)}[layout.split()[-1]]
    if layout.startswith("pretty"):
        text = json.dumps(RESULTS if "array" in layout else table, indent=2)
    if layout.startswith("zipped"):
        (tmp_path / "out.json.gz").write_bytes(gzip.compress(text.encode()))
    else:
        (tmp_path / "out.json").write_text(text)
    assert rows(read_routes(spark, str(tmp_path))) == [(i, f"T{i}") for i in range(5)]


def test_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "deeper").mkdir()
    (tmp_path / "a.json").write_text(json.dumps(RESULTS[:2], indent=1))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, RESULTS[2:])))
    (tmp_path / "deeper" / "c.json").write_text(json.dumps({"target": "X", "row_index": 77}))
    (tmp_path / "empty.json").write_text("\n  \n")
    assert rows(read_routes(spark, str(tmp_path))) == [*[(i, f"T{i}") for i in range(5)], (77, "X")]


def test_what_is_no_json_raises(spark, tmp_path):
    for i, text in enumerate([json.dumps(RESULTS[0]) + "\n{broken\n", json.dumps(RESULTS[0]) + json.dumps(RESULTS[1]), "{} rest", "no"]):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(PySparkException, match="not JSON"):
            read_routes(spark, str(tmp_path / f"{i}.json")).count()


def results(spark, found):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in found], "row_index long, j string").select("row_index", F.parse_json("j").alias("v"))


def test_nodes_and_counts(spark):
    found = [(1, {"trees": [TREE, LEAF]}), (2, {"trees": [json.dumps(TREE)]}), (3, {"trees": []}), (4, {"trees": None}), (5, {}), (6, {"trees": ["no tree"]})]
    nodes = route_nodes(results(spark, found))
    got = {(r["row_index"], r["route"], r["node"]): r for r in nodes.collect()}
    assert sorted(k for k in got if k[0] == 1) == [(1, 0, n) for n in ("0", "0.0", "0.0.0", "0.0.1", "0.0.1.0", "0.0.1.0.0")] + [(1, 1, "0")]
    assert {k[1:] for k in got if k[0] == 2} == {k[1:] for k in got if k[0] == 1 and k[1] == 0} and not [k for k in got if k[0] > 2]
    last = got[1, 0, "0.0.1.0.0"]
    assert (last["parent"], last["depth"], last["smiles"], last["in_stock"]) == ("0.0.1.0", 4, "D", None)
    counts = {(r["row_index"], r["route"]): tuple(r)[2:] for r in counted_routes(nodes).collect()}
    assert counts == {(1, 0): (2, 2, "B", "D"), (1, 1): (0, 1, "B", ""), (2, 0): (2, 2, "B", "D")}


def test_flattened_columns(spark):
    targets = spark.createDataFrame([(0, "a b/c"), (1, "__"), (2, "gone")], "row_index long, Compound_ID string")
    given = {"target": "T", "trees": [TREE], "number_of_steps": 9, "number_of_precursors": 8, "precursors_in_stock": "Z", "precursors_not_in_stock": ""}
    out = {r["row_index"]: r for r in flatten_solved(targets, results(spark, [(0, {"target": "U", "search_time": 1.5, "trees": [TREE, LEAF, LEAF]}), (1, given)]), n_routes=2).collect()}
    assert (out[0]["number_of_steps"], out[0]["number_of_precursors"], out[0]["precursors_in_stock"], out[0]["precursors_not_in_stock"], out[0]["search_time"]) == (2, 2, "B", "D", 1.5)
    assert out[0]["n_routes_exported"] == 2 and json.loads(out[0]["routes_json"]) == [TREE, LEAF]
    assert (out[1]["number_of_steps"], out[1]["precursors_in_stock"], out[1]["precursors_not_in_stock"]) == (9, "Z", "")
    assert [out[i]["html_page"] for i in range(3)] == ["targets/a_b_c.html", "targets/compound.html", "targets/gone.html"]
    assert out[2]["target"] is None and out[2]["routes_json"] == "[]" and out[2]["n_routes_exported"] == 0


def test_trees_are_unfolded_in_one_stage_without_writing(spark, monkeypatch):
    written = []
    monkeypatch.setattr(routes, "stored", lambda df, name: written.append(name) or stored(df, name))
    deep = LEAF
    for _ in range(40):
        deep = {"type": "reaction", "children": [deep, None, "x"]}
    nodes = route_nodes(results(spark, [(1, {"trees": [deep]}), (2, {"trees": [{"type": 7, "smiles": {"a": 1}, "in_stock": "true", "children": {}}]})]))
    got = {(r["row_index"], r["node"]): tuple(r)[3:] for r in nodes.collect()}
    assert len(got) == 1 + 3 * 40 + 1 and got[1, "0" + ".0" * 40] == ("0" + ".0" * 39, 40, "mol", "B", True)
    assert got[1, "0.1"] == got[1, "0.2"] == ("0", 1, None, None, None) and got[2, "0"] == (None, 0, "7", '{"a":1}', True)
    assert not written and "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_results_that_have_a_number_are_not_joined(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r | {"row_index": i + 5}) for i, r in enumerate(RESULTS)))
    found = read_routes(spark, str(tmp_path))
    assert rows(found) == [(i + 5, f"T{i}") for i in range(5)] and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_counts_from_nodes_that_know_their_children(spark):
    found = results(spark, [(1, {"trees": [TREE, LEAF]}), (2, {"trees": [json.dumps(TREE)]})])
    known, joined = counted_routes(routes.walked(found)), counted_routes(route_nodes(found))
    assert sorted(known.collect()) == sorted(joined.collect()) and "Join" not in known._jdf.queryExecution().executedPlan().toString()


def test_trees_are_counted_where_they_lie(spark):
    odd = {"type": "reaction", "children": [{"smiles": 7, "in_stock": "true"}, {"type": 3, "smiles": {"a": 1}, "in_stock": 0}, None, {"type": "reaction"}, {"smiles": "Z", "children": {}}]}
    found = results(spark, [(1, {"trees": [TREE, LEAF]}), (2, {"trees": [json.dumps(TREE), odd]}), (3, {"trees": []}), (4, {}), (5, {"trees": ["no tree", None, 3]})])
    counted = routes.route_counts(found)
    assert sorted(counted.collect()) == sorted(counted_routes(route_nodes(found)).collect())
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    targets = spark.createDataFrame([(i, "x") for i in range(1, 6)], "row_index long, Compound_ID string")
    flat = flatten_solved(targets, found)
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = {r["row_index"]: (r["number_of_steps"], r["number_of_precursors"], r["precursors_in_stock"], r["precursors_not_in_stock"]) for r in flat.collect()}
    assert got == {1: (2, 2, "B", "D"), 2: (2, 2, "B", "D"), 3: (None,) * 4, 4: (None,) * 4, 5: (None,) * 4}


def test_results_of_one_number_count_their_own_trees(spark):
    found = results(spark, [(1, {"target": "A", "trees": [TREE]}), (1, {"target": "B", "trees": [LEAF]})])
    targets = spark.createDataFrame([(1, "x")], "row_index long, Compound_ID string")
    assert sorted((r["target"], r["number_of_steps"], r["number_of_precursors"]) for r in flatten_solved(targets, found).collect()) == [("A", 2, 2), ("B", 0, 1)]
