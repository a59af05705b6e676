"""Array files, picklist runs, reports, schema precedence, compare columns, sinks."""

import json

import numpy as np
import pytest

from leadlight.functions.similarity import count_similarity
from leadlight.kernel.stage import graphs, structures
from leadlight.operators import picklists as P
from leadlight.operators.validate import find_schema, load_schema
from leadlight.plans import reports
from leadlight.plans.calculator import calculate
from leadlight.sources import arrays


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"C{i}", s) for i, s in enumerate(("CC(=O)Oc1ccccc1C(=O)O", "CCO", "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "<none>|"))]
    return calculate(structures(spark.createDataFrame(rows, "Compound_ID string, SMILES string"), drop_invalid=False)).cache()


def test_picklist_run(spark, table, tmp_path):
    lists = [P.Picklist("a", "A & B", "", "all", (P.Rule("LogP", ">", 1),), (P.Order("LogP", False),), 0, (), ()), P.BUILTIN["top_cns_followup"]]
    paths = reports.run_picklists(table, lists, str(tmp_path / "out"))
    got = spark.read.option("header", True).csv(paths["a"])
    assert [r["Compound_ID"] for r in got.collect()] == ["C2", "C0"] and set(paths) == {"a", "top_cns_followup"}
    notes = {r["name"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out/pages")).collect()}
    assert "A &amp; B" in notes["a.html"] and json.loads(notes["metadata.json"])["parameters"]["picklists"] == ["a", "top_cns_followup"]


def test_report(table):
    text = reports.build_report(table, "Lot 1")
    assert text.startswith("# Lot 1") and "4 compounds" in text and "CNS_MPO: n 3" in text
    assert all(f"## {title}" in text for _, title, _ in reports.present_categories(table.columns))
    assert "no columns" in reports.category_text(table, "shape3d") and "CNS_MPO" in reports.category_text(table, "cns_mpo")
    page = reports.html_table(table.select("SMILES"), "x")
    assert "&lt;none&gt;|" in page and "\\|" in reports.markdown_table(table.select("SMILES"))


def test_compare_columns():
    assert reports.compare_columns(["SMILES", "Canonical_SMILES", "Calc_Base_SMILES"]) == {"input": "SMILES", "prepared": "Canonical_SMILES", "calc_base": "Calc_Base_SMILES", "calc": "Calc_Base_SMILES", "protomer": None}
    assert reports.compare_columns(["x"]) == dict.fromkeys(("input", "prepared", "calc_base", "calc", "protomer"))


def test_schema_precedence(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"columns": {"A": {"type": "int"}}}')
    bundled = load_schema('{"columns": {"B": {}}}')
    assert set(find_schema(spark, str(tmp_path / "s.json"), bundled).columns) == {"A"}
    assert set(find_schema(spark, str(tmp_path / "none.json"), bundled).columns) == {"B"}
    assert "CNS_MPO" in find_schema(spark).columns


def test_array_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, [0, 5], [1.0, 2.0], bytearray(b"\x01\xff")), (0, [], [], bytearray(b"\x00\x02"))], "row long, indices array<int>, values array<float>, packed binary")
    arrays.write_sparse(rows, str(tmp_path / "s.npz"), 8)
    z = np.load(tmp_path / "s.npz")
    assert z["indptr"].tolist() == [0, 0, 2] and z["indices"].tolist() == [0, 5] and z["shape"].tolist() == [2, 8]
    arrays.write_packed(rows, str(tmp_path / "p.npy"))
    assert np.load(tmp_path / "p.npy").tolist() == [[0, 2], [1, 255]]
    g = graphs(spark.createDataFrame([(0, "CCO"), (1, "bad("), (2, "C")], "row long, SMILES string"))
    arrays.write_graphs(g, str(tmp_path / "g.npz"))
    z = np.load(tmp_path / "g.npz")
    assert z["atom_ptr"].tolist() == [0, 3, 3, 4] and z["edges"].shape == (4, 2) and z["atoms"].shape == (4, 6)
    monkeypatch.setattr(arrays, "ROW_LIMIT", 1)
    with pytest.raises(ValueError, match="more than 1 rows"):
        arrays.write_packed(rows, str(tmp_path / "q.npy"))


def test_picklist_rules(spark):
    df = spark.createDataFrame([("a", "10"), ("b", "9"), ("c", None)], "Compound_ID string, n string")
    asked = P.Picklist("k", "k", "", "all", (P.Rule("n", "contains", None),), (P.Order("n", True),), 0, (), ())
    assert [r["Compound_ID"] for r in P.run_picklist(df, asked, tie="Compound_ID").collect()] == ["b", "a", "c"]
    with pytest.raises(ValueError, match="unknown logic"):
        P.run_picklist(df, P.Picklist("k", "k", "", "some", (), (), 0, (), ()))


def test_count_metrics(spark):
    df = spark.createDataFrame([({1: 2, 2: 1}, {1: 1, 3: 4}), ({}, {})], "a map<long,int>, b map<long,int>")
    got = df.select(*[count_similarity(k, df.a, df.b).alias(k) for k in ("tanimoto", "dice", "Cosine")]).collect()
    assert tuple(got[0]) == pytest.approx((1 / 7, 2 / 8, 2 / (5**0.5 * 17**0.5))) and tuple(got[1]) == (0, 0, 0)
    with pytest.raises(ValueError, match="no count form"):
        count_similarity("sokal", df.a, df.b)


def test_screens_and_tops_take_no_summary(spark, small, monkeypatch):
    from leadlight.operators import analyze
    from leadlight.plans.catalog import QUERIES

    monkeypatch.setattr(analyze, "numeric_summary", None)
    assert QUERIES["analyze_screens"](spark, small).columns == ["category", "n", "first_id"]
    assert QUERIES["analyze_top"](spark, small).columns == ["category", "Compound_ID"]
