"""Rows that meet in blocks: pairs, counts of neighbours and greedy leaders against plain re-computation."""

import random

import pytest
from pyspark.sql import functions as F

from leadlight.operators import cluster, meetings
from leadlight.operators import search as S
from leadlight.operators.index import build_index
from leadlight.operators.medoids import Bits


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(3)
    words = [rng.getrandbits(62) for _ in range(60)]
    words += [w ^ (1 << rng.randrange(62)) for w in words[:20]] + [0, 0]
    return spark.createDataFrame([(3 * i, f"c{i}", f"s{i}", [w]) for i, w in enumerate(words)], "row long, Compound_ID string, SMILES string, fp array<long>").cache()


def plain(library, name, least):
    """(a, b) of all pairs that reach ``least``, by a product with no blocks."""
    a, b = (library.select(F.col("row").alias(f"{p}_row"), F.col("fp").alias(f"{p}_fp")) for p in "ab")
    value = S.similarity(name, S.words(F.col("a_fp"), 62), S.words(F.col("b_fp"), 62), 62)
    return {(r["a_row"], r["b_row"]) for r in a.crossJoin(b).where((F.col("a_row") < F.col("b_row")) & (value >= least)).collect()}


@pytest.mark.parametrize(("name", "least"), [("tanimoto", 0.4), ("asymmetric", 0.6), ("cosine", 0.55)])
@pytest.mark.parametrize("crowd", [20, 8192])
def test_near_pairs(library, monkeypatch, name, least, crowd):
    monkeypatch.setattr(meetings, "CROWD", crowd)
    found = meetings.near_pairs(library.select("row", F.col("fp").alias("x")), Bits(name, 62), least).collect()
    assert sorted((r["a_row"], r["b_row"]) for r in found) == sorted(plain(library, name, least))


def test_rows_with_many_common_bits_meet_in_blocks(library):
    plan = S.similar_pairs(library, 62, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("window", [7, 8192])
def test_leaders_list_no_pairs(library, monkeypatch, window):
    monkeypatch.setattr(meetings, "WINDOW", window)
    monkeypatch.setattr(cluster, "similar_pairs", None)
    pairs, rows = plain(library, "tanimoto", 0.45), [r["row"] for r in library.select("row").orderBy("row").collect()]
    ids, starts = {}, []
    for r in rows:
        first = next((s for s in starts if (s, r) in pairs), r)
        starts += [r] * (first == r)
        ids[r] = starts.index(first), first == r
    assert {r["row"]: (r["Cluster_ID"], r["Is_Centroid"]) for r in cluster.leader_clusters(library, 62, 0.45).collect()} == ids


@pytest.mark.parametrize("crowd", [20, 8192])
def test_butina_lists_no_pairs(library, monkeypatch, crowd):
    monkeypatch.setattr(meetings, "CROWD", crowd)
    monkeypatch.setattr(meetings, "WINDOW", crowd)
    pairs = S.similar_pairs(library, 62, 0.4).select("a_row", "b_row")
    want = {r["row"]: (r["Cluster_ID"], r["Cluster_Size"]) for r in cluster.butina(library, pairs).collect()}
    monkeypatch.setattr(cluster, "similar_pairs", None)
    assert {r["row"]: (r["Cluster_ID"], r["Cluster_Size"]) for r in cluster.butina_clusters(library, 62, 0.4).collect()} == want


@pytest.mark.parametrize(("name", "least"), [("tanimoto", 0.6), ("dice", 0.8)])
def test_equal_count_maps_are_compared_as_one(spark, monkeypatch, name, least):
    compared, meet = [], S.candidate_pairs
    monkeypatch.setattr(S, "UNIT", 4)
    monkeypatch.setattr(S, "candidate_pairs", lambda rows, *more: compared.append(rows.count()) or meet(rows, *more))
    maps = [{"a": 3, "b": 1}, {"b": 1, "a": 3}, {"a": 3, "b": 2}, {"c": 1}, {"a": 1, "c": 9, "d": 0}]
    rows = [(i, maps[i * 7 % 5]) for i in range(60)]
    got = {(r["a_row"], r["b_row"]): r["similarity"] for r in S.similar_counts(spark.createDataFrame(rows, "row long, counts map<string,int>"), least, name).collect()}

    def value(x, y):
        low, both = sum(min(x.get(k, 0), y.get(k, 0)) for k in x), sum(x.values()) + sum(y.values())
        return low / (both - low) if name == "tanimoto" else 2 * low / both

    want = {(i, j): value(a, b) for i, a in rows for j, b in rows if i < j and value(a, b) >= least}
    assert got == pytest.approx(want) and compared == [4]


def test_a_block_hands_on_only_the_best_rows_of_a_query(library):
    index = build_index(library, 62)
    plan = index.plan(library.where("row < 30"), "tanimoto").withColumn("floor", F.lit(0.0))
    found = index.scored(plan, 10, "tanimoto", 3).collect()
    blocks, queries = index.blocks.count(), {r["a_row"] for r in found}
    assert len(queries) == 10 and len(found) <= 10 * 3 * blocks < 10 * library.count()
    best = {r["a_row"]: max(x["similarity"] for x in found if x["a_row"] == r["a_row"]) for r in found}
    assert all(v == 1.0 for v in best.values())


@pytest.mark.parametrize("query", ["similarity_counts_join", "similarity_counts_join_dice"])
def test_pairs_of_rows_are_unpacked_one_list_at_a_time_and_rounded_before(spark, small, query):
    from leadlight.plans.queries import QUERIES

    lines = [line.strip(" :+-") for line in QUERIES[query](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    one, other = (next(i for i, line in enumerate(lines) if line.startswith(f"Generate explode({side}_rows")) for side in "ba")
    assert one < other and any(line.startswith("Repartition ") and "false" in line for line in lines[one:other])
    assert not any("round(" in line for line in lines[:other]) and any("round(" in line for line in lines[other:])


def test_rows_of_a_kind_in_order(spark, monkeypatch):
    monkeypatch.setattr(S, "UNIT", 8)
    df = spark.createDataFrame([(i * 37 % 41, {"a": 1 + i % 2, "b": 7}) for i in range(41)], "row long, counts map<string,int>").repartition(4)
    got = S.similar_counts(df, 0.8, digits=2)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 41 * 40 // 2 and {r[2] for r in rows} == {0.89, 1.0} and all(a < b for a, b, _ in rows)
