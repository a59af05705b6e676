"""Null semantics, missing columns, order and limit of picklists."""

import itertools
import json
import warnings

import pytest

from leadlight.operators import picklists as P

ROWS = [(1, 1.0, "High", True), (2, 2.0, "low", False), (3, None, None, None), (4, float("nan"), "7", True)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "row int, num double, word string, flag boolean")


def kept(df, *rules, logic="all"):
    return sorted(r["row"] for r in P.run_picklist(df, P.Picklist("k", "k", logic=logic, filters=rules)).collect())


CASES = [
    (P.Rule("num", "==", 1), [1]),
    (P.Rule("num", "!=", 1), [2, 3, 4]),
    (P.Rule("num", ">", 1), [2]),
    (P.Rule("num", ">=", 1), [1, 2]),
    (P.Rule("num", "<", 2), [1]),
    (P.Rule("num", "<=", 2), [1, 2]),
    (P.Rule("word", ">", 5), [4]),
    (P.Rule("num", "in", [1, 2]), [1, 2]),
    (P.Rule("num", "in", 2), [2]),
    (P.Rule("num", "notin", [1]), [2, 3, 4]),
    (P.Rule("word", "in", ["High"]), [1]),
    (P.Rule("word", "contains", "IG"), [1]),
    (P.Rule("word", "notcontains", "i"), [2, 3, 4]),
    (P.Rule("word", "contains", "."), []),
    (P.Rule("num", "isnull"), [3, 4]),
    (P.Rule("num", "notnull"), [1, 2]),
    (P.Rule("num", "between", 1, 1.5), [1]),
    (P.Rule("flag", "==", True), [1, 4]),
    (P.Rule("flag", "!=", True), [2, 3]),
    (P.Rule("flag", "in", [True, "True", "Yes", "Y"]), [1, 4]),
    (P.Rule("word", "==", True), []),
    (P.Rule("num", "==", "1"), []),
    (P.Rule("word", "==", 7), []),
    (P.Rule("flag", "==", 1), [1, 4]),
]


@pytest.mark.parametrize(("rule", "want"), CASES)
def test_operator(df, rule, want):
    assert kept(df, rule) == want


@pytest.mark.parametrize(("missing", "logic"), itertools.product(P.MISSING, ("all", "any")))
def test_missing_column(df, missing, logic):
    rules = (P.Rule("nowhere", ">", 1, missing=missing), P.Rule("num", "==", 1))
    if missing == "fail":
        with pytest.raises(ValueError, match="nowhere"):
            kept(df, *rules, logic=logic)
        return
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = kept(df, *rules, logic=logic)
    assert got == ([] if (missing, logic) == ("false", "all") else [1])


def test_no_filters(df):
    assert kept(df) == [1, 2, 3, 4]
    assert kept(df, logic="any") == []


def test_unknown_operator(df):
    with pytest.raises(ValueError, match="unknown operator"):
        kept(df, P.Rule("num", "~", 1))


def test_order_puts_null_and_nan_last(df):
    for ascending, want in ((True, [1, 2, 3, 4]), (False, [2, 1, 3, 4])):
        p = P.Picklist("k", "k", sort=(P.Order("num", ascending), P.Order("nowhere")))
        assert [r["row"] for r in P.run_picklist(df, p, "row").collect()] == want


def test_limit(df):
    assert [r["row"] for r in P.run_picklist(df, P.Picklist("k", "k", sort=(P.Order("row", False),), limit=2)).collect()] == [4, 3]


def test_limit_is_a_top_k(df):
    plan = P.run_picklist(df, P.Picklist("k", "k", sort=(P.Order("row", False),), limit=2))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_load_and_resolve():
    text = json.dumps({"picklists": [{"key": "a", "filters": [{"column": "num", "op": ">", "value": 1}], "sort": [{"column": "num", "ascending": False}], "limit": 5}]})
    a = P.load_picklists(text)["a"]
    assert (a.name, a.limit, a.filters[0].op, a.sort[0].ascending) == ("a", 5, ">", False)
    assert list(P.load_picklists(json.dumps({"b": {"filters": []}}))) == ["b"]
    with pytest.raises(ValueError, match="key"):
        P.load_picklists(json.dumps([{"name": "x"}]))
    mine = P.Picklist("top_cns_followup", "mine")
    assert P.resolve(["top_cns_followup"], {"top_cns_followup": mine}) == [mine]
    with pytest.raises(ValueError, match="unknown picklists"):
        P.resolve(["zzz"])


def test_projection_stops_adding():
    columns = ["Compound_ID", "CNS_MPO", "RO5_Pass", "Tox_Risk", "hERG_Risk", *[f"Tox_{i}" for i in range(40)]]
    out = P.output_columns(columns, "Compound_ID", P.BUILTIN["top_cns_followup"])
    assert out[:5] == ["Compound_ID", "CNS_MPO", "RO5_Pass", "Tox_Risk", "hERG_Risk"]
    assert len(out) == P.PROJECTION
    assert P.output_columns(columns, "Compound_ID", P.Picklist("k", "k", output_columns=("Tox_1", "zzz"))) == ["Compound_ID", "Tox_1"]


def test_numeric_text(spark):
    df = spark.createDataFrame([("10", "a"), ("9", None), (None, "1")], "x string, y string")
    assert P.numeric_text_columns(df, ["x", "y"]) == ["x"]
