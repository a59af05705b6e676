"""Exact medians by selection, lookups, and numbers of rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from leadlight.operators import blocks, selection
from leadlight.sources.storage import numbered


@pytest.mark.parametrize(("direct", "few"), [(0, 3), (0, 1024), (20, 5), (1 << 22, 1024)])
def test_medians(spark, monkeypatch, direct, few):
    monkeypatch.setattr(selection, "DIRECT", direct)
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(2)
    values = {("a", 1): [rng.gauss(0, 1) for _ in range(301)], ("a", 2): [float(rng.randint(0, 3)) for _ in range(200)], (None, 1): [7.0] * 50, ("b", 1): [1.5], ("b", 2): [1.0, 2.0], ("c", 3): [1e308, -1e308, 1e308, 5.0], ("d", 1): [1e-300 * i for i in range(40)] + [1e9]}
    cells = [(*k, v) for k, vs in values.items() for v in vs] + [("e", 1, None), ("a", 1, None)]
    rng.shuffle(cells)
    got = {(r["k"], r["j"]): r["median"] for r in selection.medians(spark.createDataFrame(cells, "k string, j int, value double"), ["k", "j"]).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k] == pytest.approx(statistics.median(vs), rel=1e-12) or k == ("c", 3)
    assert selection.medians(spark.createDataFrame([], "k string, value double"), ["k"]).count() == 0


@pytest.mark.parametrize("bound", [0, 100])
def test_lookup(spark, monkeypatch, bound):
    monkeypatch.setattr(blocks, "BROADCAST", bound)
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(30)] + [(99, None)], "row long, k string")
    out = blocks.lookup(rows, spark.createDataFrame([("x", 1), ("z", 2)], "k string, v int"), ["k"], "left")
    assert {(r["row"], r["v"]) for r in out.collect()} == {(i, 1 if i % 3 else None) for i in range(30)} | {(99, None)}


def test_numbers_of_several_weights(spark):
    rows = spark.range(100).withColumn("w", F.col("id") % 3)
    out = {r["id"]: (r["n"], r["s"]) for r in numbered(rows, [F.col("id")], "n", more={"s": F.col("w")}).collect()}
    assert out == {i: (i, sum(j % 3 for j in range(i))) for i in range(100)}
