"""Sources, export, validation, features, streaming, and queries against their SQL."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadlight.operators import analyze as A
from leadlight.operators import features as X
from leadlight.operators import validate as V
from leadlight.plans import categories as G
from leadlight.plans.adapters import compounds
from leadlight.plans.calculator import calculate, export_order
from leadlight.sources import smiles as L
from leadlight.sources import tables as T
from leadlight.streaming.stateless import calculate_stream, read_stream, write_stream


def test_formats():
    assert [T.detect_format(p) for p in ("a.parquet", "a.PQ", "a.tsv", "a.tab", "a.csv", "a.txt")] == ["parquet", "parquet", "tsv", "tsv", "csv", "csv"]
    with pytest.raises(ValueError, match="unknown format"):
        T.detect_format("a", "xls")


def test_columns():
    assert G.id_column(["x", "Name", "compound_id"]) == "compound_id"
    assert G.id_column(["x", "y"]) == "x"
    assert G.smiles_column(["SMILES", "Canonical_SMILES"]) == "Canonical_SMILES"
    assert G.smiles_column(["SMILES", "Canonical_SMILES"], preferred="SMILES") == "SMILES"
    assert G.smiles_column(["a", "MySmiles"]) == "MySmiles" and G.smiles_column(["a"]) is None
    assert G.category_columns(["Tox_b", "Tox_Risk", "x"], "toxicity") == ["Tox_Risk", "Tox_b"]
    assert len(G.CATEGORIES) == 19
    assert export_order(["zz", "LogP", "Compound_ID", "aa"]) == ["Compound_ID", "LogP", "aa", "zz"]


@pytest.mark.parametrize("fmt", ["csv", "tsv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1.5, "x,\ty", True), ("b", float("nan"), None, None)], "Compound_ID string, `cLogD_7.4` double, note string, RO5_Pass boolean")
    path = str(tmp_path / f"t.{fmt}")
    T.write_table(df, path)
    back = T.read_table(spark, path)
    assert back.columns == ["Compound_ID", "RO5_Pass", "cLogD_7.4", "note"]
    assert sorted(map(tuple, back.collect())) == [("a", True, 1.5, "x,\ty"), ("b", None, None, None)]
    T.write_table(df, path, fill=0)
    assert T.read_table(spark, path).where(F.col("`cLogD_7.4`") == 0).count() == 1
    meta = json.loads(T.metadata(spark, "tool", [path], {"a": 1}))
    assert meta["parameters"] == {"a": 1} and all(len(f["sha256"]) == 64 for f in meta["inputs"])


def test_smiles_dialects(spark, tmp_path):
    text = "# head\n\nAspirin\tCC(=O)O\nCC(=O)O\tAspirin\nCCO ethanol\nN#C, hcn\nC1CC1\n"
    (tmp_path / "l.smi").write_text(text)
    rows = lambda d: [tuple(r) for r in L.read_smiles(spark, str(tmp_path / "l.smi"), d).orderBy("row").collect()]
    assert rows("calculator") == [(3, "Aspirin", "CC(=O)O"), (4, "Aspirin", "CC(=O)O"), (5, "CCO", "ethanol"), (6, "hcn", "N#C"), (7, "cmpd_7", "C1CC1")]
    assert rows("similarity")[2] == (5, "ethanol", "CCO") and rows("similarity")[0][2] == "Aspirin"
    assert rows("retro")[4] == (7, "row7", "C1CC1")
    with pytest.raises(ValueError, match="dialect"):
        L.parse_lines(spark.createDataFrame([], "line long, value string"), "x")
    assert [r["Compound_ID"] for r in L.load_library(spark, ["C", "CC"]).orderBy("row").collect()] == ["Compound_1", "Compound_2"]
    table = spark.createDataFrame([("n", "CC")], "Name string, my_smiles string")
    assert tuple(L.load_library(spark, table).first()) == (0, "n", "CC")


def test_validation(spark):
    schema = V.load_schema(json.dumps({"columns": {"Compound_ID": {"type": "string", "required": True, "tags": ["id"]}, "LogP": {"type": "float"}, "n": {"type": "int"}}, "patterns": [{"pattern": "^Tox_", "type": "int"}]}))
    good = spark.createDataFrame([("a", "1.5", 1.0, 0), ("b", None, 2.0, 1)], "Compound_ID string, LogP string, n double, Tox_x int")
    report = V.validate(good, schema, ["toxicity"])
    assert report.passed and report.text().endswith("Result: PASS")
    bad = V.validate(good.drop("Compound_ID").withColumn("LogP", F.lit("x")).withColumn("n", F.lit(0.5)).withColumn("other", F.lit(1)), schema, ["herg"])
    assert (bad.missing, bad.empty_categories, bad.unknown, {c for c, _, _ in bad.mistyped}) == (("Compound_ID",), ("herg",), ("other",), {"LogP", "n"})
    assert V.validate(good.limit(0), schema).passed
    assert "## id" in V.schema_markdown(schema)


def test_analyses_tolerate_missing_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "Compound_ID string, QED double")
    for key in A.ANALYSES:
        for part in A.analyze(df, key).values():
            part.collect()
    assert A.histogram(df.where("false"), "QED").count() == 0
    assert A.histogram(df, "QED", 4).agg(F.sum("n")).first()[0] == 1
    assert A.prevalence(df, []).count() == 0


def test_packed_bytes(spark):
    df = spark.createDataFrame([([True, False, False, False, False, False, False, True, True],)], "b array<boolean>")
    assert bytes(df.select(X.packed_bytes("b", 9)).first()[0]) == b"\x81\x80"


def test_frozen_vocabulary(spark):
    spec = X.freeze({"Frag": ["a", "b"]}, {"H": 8})
    assert json.loads(spec)["blocks"][1] == {"name": "Frag", "size": 2, "offset": 8}
    assert sorted(map(tuple, X.frozen_vocabulary(spark, spec, "Frag").collect())) == [("a", 0), ("b", 1)]


def test_stream_equals_batch(spark, small, tmp_path):
    rows = compounds(spark, small)
    rows.write.parquet(str(tmp_path / "in"))
    out = calculate_stream(read_stream(spark, str(tmp_path / "in"), rows.schema)).select("row", "CNS_MPO")
    query = write_stream(out, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, calculate(rows).select("row", "CNS_MPO").collect()))


def test_rules_need_no_python(spark, small):
    plan = calculate(compounds(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["rules_developability", "picklist_operators", "analyze_rates", "report_histogram", "similarity_threshold_join", "scaffold_outliers", "feature_sparse_rows", "smiles_parse"])
def test_queries_against_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("part", "embeddings"):
        db.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    want, got = db.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, small)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    cell = lambda v: round(v, 8) if isinstance(v, float) else v
    rows = lambda names, data: sorted(repr([cell(dict(zip(names, r, strict=True))[c]) for c in order]) for r in data)
    assert rows(want.columns, want.fetchall()) == rows(got.columns, [tuple(r) for r in got.collect()])


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.count() > 0 and "CNS_MPO" in df.columns
