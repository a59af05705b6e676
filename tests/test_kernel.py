"""The structure kernel: counts of well-known molecules, patterns, scaffolds, graphs, invalid texts."""

import pytest
from pyspark.sql import functions as F

from leadlight.kernel import pure as K
from leadlight.kernel.stage import FIELDS, STEREO, graphs, prepared, prepared_structures, structures, through, values
from leadlight.operators.features import graph_offsets
from leadlight.plans.catalog import QUERIES

ASPIRIN = "CC(=O)Oc1ccccc1C(=O)O"
#: Queries whose structures are dealt out before they are read.
DEALT = ["kernel_groups", "kernel_count_cells", "kernel_outcome", "kernel_prepare", "kernel_structures", "kernel_complexity"]


@pytest.mark.parametrize(
    ("smiles", "weight", "tpsa", "donors", "rotatable", "rings"),
    [(ASPIRIN, 180.159, 63.6, 1, 3, 1), ("CC(=O)Nc1ccc(O)cc1", 151.165, 49.33, 2, 1, 1), ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", 206.285, 37.3, 1, 4, 1), ("c1ccc2ccccc2c1", 128.174, 0.0, 0, 0, 2), ("CCO", 46.069, 20.23, 1, 0, 0)],
)
def test_descriptors(smiles, weight, tpsa, donors, rotatable, rings):
    d = K.descriptors(K.parse(smiles))
    assert (d["MolWt"], d["TPSA"], d["HBD"], d["RotBonds"], d["Rings"]) == (pytest.approx(weight, abs=0.01), pytest.approx(tpsa, abs=0.01), donors, rotatable, rings)


@pytest.mark.parametrize(("smiles", "pattern", "n"), [(ASPIRIN, "ester", 1), (ASPIRIN, "carboxylic_acid", 1), (ASPIRIN, "phenol", 0), ("CC(=O)N(C)C", "basic_n", 0), ("CN(C)C", "tertiary_amine", 1), ("c1cnc[nH]1", "imidazole", 1), ("O=C1C=CC(=O)C=C1", "quinone", 1), ("C1=CC=CC=C1", "aromatic_six", 1), ("C1OC1C", "epoxide", 1), ("CC#C", "acetylene", 1)])
def test_patterns(smiles, pattern, n):
    assert K.count(K.parse(smiles), K.PANEL[pattern]) == n


@pytest.mark.parametrize("bad", ["", "C(", "c1ccc", "[Xx]", "C==", "1CC", "CC)", "=C", "C=", "Ä"])
def test_invalid(bad):
    with pytest.raises(K.ParseError):
        K.parse(bad)


def test_all_patterns_compile():
    mol = K.parse(ASPIRIN)
    assert all(K.count(mol, p) >= 0 for p in [*K.PANEL.values(), *K.GROUPS.values()])


@pytest.mark.parametrize("smiles", [ASPIRIN, "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "c1ccc(cc1)CCc1ccccc1", "[O-][N+](=O)c1ccccc1"])
def test_written_text_is_stable(smiles):
    text = K.write(K.parse(smiles))
    assert K.write(K.parse(text)) == text
    assert K.descriptors(K.parse(text)) == K.descriptors(K.parse(smiles))
    assert K.circular(K.parse(text)) == K.circular(K.parse(smiles))


def test_scaffolds():
    assert K.scaffold(K.parse("CCCC")) == ""
    assert K.scaffold(K.parse("CCc1ccccc1")) == K.scaffold(K.parse("c1ccccc1O")) == "c1ccccc1"


def test_stage(spark):
    df = spark.createDataFrame([(0, "CCO", "a"), (1, "bad", "b"), (2, None, "c"), (3, ASPIRIN, "d")], "row long, SMILES string, MolWt string")
    rows = {r["row"]: r for r in structures(df).collect()}
    assert set(rows) == {0, 3} and len(rows[3]["fp"]) == 32 and rows[3]["Patterns"]["ester"] == 1
    assert structures(df, drop_invalid=False).count() == 4
    found = {r["row"]: r for r in graph_offsets(graphs(df)).collect()}
    assert [found[i]["n_atoms"] for i in range(4)] == [3, 0, 0, 13]
    assert [found[i]["atom_start"] for i in range(4)] == [0, 3, 3, 3]
    assert found[3]["edge_start"] == found[0]["n_edges"] == 4
    assert structures(df.limit(0)).count() == 0


def test_rows_of_one_file_meet_many_tasks_and_equal_texts_once(spark):
    made = []
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(600)], "row long, SMILES string").coalesce(1)
    found = through(df, "SMILES", "n int", lambda s: {"n": made.append(s) or len(made)} if s != "c" else None).withColumn("task", F.spark_partition_id()).collect()
    by_task = {t: {(r["SMILES"], r["n"]) for r in found if r["task"] == t} for t in {r["task"] for r in found}}
    assert len(found) == 600 and len(by_task) > 4
    assert all(len(v) <= 3 and all((n is None) == (s == "c") for s, n in v) for v in by_task.values())


@pytest.mark.parametrize("name", DEALT)
def test_structures_of_one_file_are_dealt_out(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" in plan


def test_count_cells_read_structures_once_and_shuffle_no_cells(spark, small):
    plan = QUERIES["kernel_count_cells"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("hashpartitioning") == 1


def test_graphs_are_dealt_out(spark):
    df = spark.createDataFrame([(0, "CCO")], "row long, SMILES string").coalesce(1)
    assert "RoundRobinPartitioning" in graphs(df)._jdf.queryExecution().toString()


def test_a_panel_is_counted_like_its_patterns():
    texts = [ASPIRIN, "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "CC(=O)Nc1ccc(O)cc1", "[O-][N+](=O)c1ccccc1", "CN(C)CC#C", "O=C1C=CC(=O)C=C1", "c1cc2OCOc2cc1CCN", "CCNC(=S)N", "CS(=O)(=O)O", "c1cnc[nH]1", "C1OC1CN1CC1", "C"]
    for mol in map(K.parse, texts):
        for panel in (K.PANEL, K.GROUPS):
            assert K.counts(mol, panel) == {k: K.count(mol, p) for k, p in panel.items()}


def test_an_expression_is_tested_once_for_all_patterns(monkeypatch):
    tried = []
    query = K.Query([lambda mol, i: tried.append(i) or mol.atoms[i].symbol == "O"] * 2, [{}, {0: ""}], ["O", "O"])
    monkeypatch.setattr(K, "compile_smarts", lambda smarts: query)
    assert K.counts(K.parse("CCOO"), {"a": "OO", "b": "OO"}) == {"a": 1, "b": 1}
    assert tried == [0, 1, 2, 3]


def test_calculated_tables_make_no_texts(spark, small):
    plan = QUERIES["kernel_structures"](spark, small)._jdf.queryExecution().toString()
    assert "Canonical_SMILES" not in plan and "Patterns" in plan


def test_only_the_fields_asked_for_are_made(spark):
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    whole = values(ASPIRIN)
    assert set(whole) == set(names)
    for name in names:
        assert values(ASPIRIN, wanted=[name])[name] == whole[name]
    df = spark.createDataFrame([(0, "CCO", "a"), (1, "bad", "b"), (2, None, "c")], "row long, SMILES string, MolWt string")
    some = structures(df, drop_invalid=False, fields=["LogP"])
    assert some.columns == ["row", "SMILES", "MolWt", "LogP", "HeavyAtoms"]
    assert {r["row"]: r["HeavyAtoms"] for r in some.collect()} == {0: 3, 1: None, 2: None}
    assert structures(df, fields=["LogP"]).collect()[0]["LogP"] == values("CCO")["LogP"]
    with pytest.raises(ValueError, match="no such field"):
        structures(df, fields=["Weight"])


def test_an_outcome_needs_no_patterns(spark, small):
    query = QUERIES["kernel_outcome"](spark, small)._jdf.queryExecution().toString()
    assert "Patterns" not in query and "HeavyAtoms" in query


def test_prepared_structures_are_those_of_two_steps(spark):
    texts = ["[Na+].CC(=O)[O-]", "C[NH3+].[Cl-]", ASPIRIN, "bad", None, "", "OC(=O)c1ccccc1.O"]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, SMILES string")
    for drop in (True, False):
        two = structures(prepared(df).drop(*STEREO), "Prepared_SMILES", drop_invalid=drop)
        one = prepared_structures(df, drop_invalid=drop)
        assert set(one.columns) == set(two.columns)
        assert sorted(map(str, one.select(two.columns).collect())) == sorted(map(str, two.collect()))
    some = prepared_structures(df, fields=["LogP"])
    assert {"LogP", "HeavyAtoms", "Prepared_SMILES", *STEREO} <= set(some.columns) and "MolWt" not in some.columns
    assert {r["row"]: r["Stereo_Status"] for r in some.collect()} == {r["row"]: r["Stereo_Status"] for r in prepared(df).collect() if r["Stereo_Status"]}


def test_preparation_and_values_cross_once(spark, small):
    plan = QUERIES["kernel_prepare"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("RoundRobinPartitioning") == 1


def test_graphs_are_made_once_for_their_places(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def make(s):
        with open(seen, "a") as out:
            out.write(f"{s}\n")
        return {"n_atoms": int(s), "n_edges": 2 * int(s)}

    df = spark.createDataFrame([(i, str(i)) for i in range(200)], "row long, SMILES string")
    found = graph_offsets(through(df, "SMILES", "n_atoms int, n_edges int", make)).collect()
    assert {r["row"]: (r["atom_start"], r["edge_start"]) for r in found} == {i: (i * (i - 1) // 2, i * (i - 1)) for i in range(200)}
    with open(seen) as lines:
        assert len(lines.readlines()) == 200
