"""Feature export from a frozen specification."""

import json

import pytest

from leadlight.operators import export as E


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, "a", 1.5, ["x", "y", "x"], {3: 1, 11: 2}), (1, "b", 0.0, ["y", "z"], {}), (2, "c", float("nan"), None, {8: 5}), (3, "d", -2.0, ["new", None, "x"], None)]
    return spark.createDataFrame(data, "row long, Compound_ID string, MolWt double, Frag array<string>, Counts map<long, int>")


def dense(matrix, width):
    out = {}
    for r in matrix.collect():
        line = [0.0] * width
        for i, v in zip(r["indices"], r["values"], strict=True):
            line[i] = v
        out[r["row"]] = line
    return out


def test_two_runs_have_equal_columns(spark, rows):
    spec = E.specify(rows.where("row < 2"), ["MolWt"], ["Frag"], hashed={"FP": 8})
    assert json.loads(spec)["names"] == {"Named": ["MolWt"], "Frag": ["x", "y", "z"]} and json.loads(spec)["spec_version"] == E.VERSION
    matrix, dropped = E.export(rows, "row", spec, {"FP": "Counts"})
    want = {0: [0, 0, 0, 3, 0, 0, 0, 0, 1.5, 1, 1, 0], 1: [0] * 10 + [1, 1], 2: [5] + [0] * 11, 3: [0] * 8 + [-2, 1, 0, 0]}
    assert dense(matrix, 12) == want
    assert {r["row"]: r["start"] for r in matrix.collect()} == {0: 0, 1: 4, 2: 6, 3: 7}
    assert [tuple(r) for r in dropped.collect()] == [("Frag", "new", 1)]
    part, _ = E.export(rows.where("row > 1"), "row", spec, {"FP": "Counts"})
    assert dense(part, 12) == {i: want[i] for i in (2, 3)}


def test_written_export(spark, rows, tmp_path):
    spec = E.specify(rows, ["MolWt"], ["Frag"], least=2, hashed={})
    E.write_export(rows, "row", "Compound_ID", spec, {}, str(tmp_path / "out"))
    assert (tmp_path / "out/spec.json").read_text() == spec
    assert spark.read.parquet(str(tmp_path / "out/matrix")).count() == spark.read.parquet(str(tmp_path / "out/ids")).count() == 4
    assert {(r["name"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out/dropped")).collect()} == {("z", 1), ("new", 1)}


def test_specifications_are_checked(spark, rows):
    for text, message in (("[]", "no spec_version"), ("{}", "no spec_version"), (json.dumps({"spec_version": 99}), "newer")):
        with pytest.raises(ValueError, match=message):
            E.read_spec(text)
    empty, dropped = E.export(rows.where("false"), "row", E.specify(rows, ["MolWt"], ["Frag"], hashed={}), {})
    assert empty.count() == 0 and dropped.count() == 0
