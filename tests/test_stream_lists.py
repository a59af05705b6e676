"""Picklists over a stream equal those over the whole table."""

import random

import pytest

from leadlight.operators import picklists as P
from leadlight.streaming import ranked

LISTS = [
    P.Picklist("low", "", "", "all", (P.Rule("x", "<", 0.8),), (P.Order("x", True), P.Order("name", False)), 7, (), ()),
    P.Picklist("high", "", "", "any", (P.Rule("x", ">", 0.2), P.Rule("name", "==", "b")), (P.Order("name", False), P.Order("x", False)), 5, (), ()),
]


def test_stream_equals_batch(spark, tmp_path):
    rng, schema, seen = random.Random(6), "id long, x double, name string", []
    for part in range(4):
        rows = [(100 * part + i, rng.choice([None, round(rng.random(), 1)]), rng.choice(["a", "b", "c", None])) for i in range(30)]
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ranked.keep_best(stream, LISTS, "id", str(tmp_path / "best"), str(tmp_path / "check")).awaitTermination()
        want = P.run_together(spark.createDataFrame(seen, schema), LISTS, "id")
        got = ranked.best_rows(spark, str(tmp_path / "best"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert [r["rank"] for r in ranked.ordered(got, "low").collect()] == list(range(1, 8))
    assert len(list((tmp_path / "best").iterdir())) <= ranked.VERSIONS
    with pytest.raises(ValueError, match="without a limit: all"):
        ranked.keep_best(stream, [P.Picklist("all", "", "", "all", (), (), 0, (), ())], "id", "x", "y")


def test_run_together_equals_each_list(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, float("nan"), rng.gauss(0, 1)]), rng.choice(["a", "b", None]), str(rng.randint(1, 30)), rng.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, name string, n string, flag boolean")
    lists = [
        *LISTS,
        P.Picklist("numbers", "", "", "all", (), (P.Order("n", False), P.Order("flag", True)), 0, (), ()),
        P.Picklist("gone", "", "", "all", (P.Rule("x", ">", 99),), (), 3, (), ()),
        P.Picklist("plain", "", "", "all", (P.Rule("flag", "==", True),), (), 0, (), ()),
    ]
    got = P.run_together(df, lists, "id").collect()
    for p in lists:
        mine = [r["id"] for r in sorted((r for r in got if r["picklist"] == p.key), key=lambda r: r["rank"])]
        want = [r["id"] for r in P.run_picklist(df, p, tie="id").collect()]
        assert mine == want if p.sort else sorted(mine) == sorted(want), p.key
    with pytest.raises(ValueError, match="one key"):
        P.run_together(df, [LISTS[0], LISTS[0]], "id")
