"""Metrics, search, clustering and picks against plain re-computation."""

import random

import pytest
from pyspark.sql import functions as F

from leadlight.functions.similarity import METRICS, density, metric, on_bits, pack, similarity, words
from leadlight.operators import cluster as C
from leadlight.operators import search as S

N_BITS = 130


def fingerprint(rng, near=None):
    if near is None:
        return {i for i in range(N_BITS) if rng.random() < 0.2}
    return near ^ {rng.randrange(N_BITS) for _ in range(rng.randint(0, 8))}


def to_words(bits):
    out = [sum(1 << (b - 64 * w) for b in bits if b // 64 == w) for w in range(-(-N_BITS // 64))]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def plain(name, a, b):
    x, y, c, n = len(a), len(b), len(a & b), N_BITS
    return {
        "tanimoto": lambda: c / len(a | b) if a | b else 0.0,
        "dice": lambda: 2 * c / (x + y) if x + y else 0.0,
        "cosine": lambda: c / (x * y) ** 0.5 if x * y else 0.0,
        "sokal": lambda: (c + n - x - y + c) / n,
        "russel": lambda: c / n,
        "kulczynski": lambda: (c / x + c / y) / 2 if x and y else 0.0,
        "mcconnaughey": lambda: (c * c - (x - c) * (y - c)) / (x * y) if x * y else 0.0,
        "asymmetric": lambda: c / x if x else 0.0,
        "braun_blanquet": lambda: c / max(x, y) if max(x, y) else 0.0,
    }[name]()


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(8)
    out = []
    for _ in range(12):
        base = fingerprint(rng)
        out += [base] + [fingerprint(rng, base) for _ in range(rng.randint(0, 9))]
    return [*out, set(), set(range(N_BITS)), set(out[0])]


@pytest.fixture(scope="module")
def library(spark, sets):
    rows = [(i, f"c{i}", f"s{i % 7}", to_words(s)) for i, s in enumerate(sets)] + [(len(sets), "bad", "zz", None)]
    return spark.createDataFrame(rows, "row long, Compound_ID string, SMILES string, fp array<long>").cache()


@pytest.mark.parametrize("name", list(METRICS))
def test_metrics(library, sets, name):
    query = to_words(sets[3])
    got = {r["row"]: r["s"] for r in library.where("fp is not null").select("row", similarity(name, [F.lit(w) for w in query], words(F.col("fp"), N_BITS), N_BITS).alias("s")).collect()}
    assert got == pytest.approx({i: plain(name, sets[3], s) for i, s in enumerate(sets)})


def test_metric_names():
    assert metric("Tanimoto") is METRICS["tanimoto"]
    with pytest.raises(ValueError, match="unknown metric"):
        metric("nope")


def test_bits(library, sets):
    rows = library.where("fp is not null").select("row", on_bits(F.col("fp"), N_BITS).alias("b"), density(F.col("fp"), N_BITS).alias("d")).collect()
    assert all(set(r["b"]) == sets[r["row"]] and r["d"] == pytest.approx(len(sets[r["row"]]) / N_BITS) for r in rows)


def test_pack(spark):
    flags = [random.Random(i).random() < 0.5 for i in range(70)]
    got = spark.range(1).select(pack([F.lit(f) for f in flags]).alias("p")).first()["p"]
    assert {i for i in range(70) if got[i // 64] >> (i % 64) & 1} == {i for i, f in enumerate(flags) if f}


def ranked(sets, query, threshold, name="tanimoto"):
    scored = [(plain(name, query, s), i) for i, s in enumerate(sets)]
    return [i for s, i in sorted(((-s, i) for s, i in scored if s >= threshold))]


def test_search(library, sets):
    for top in (None, 5):
        rows = S.search(library, to_words(sets[0]), N_BITS, threshold=0.3, top=top).orderBy("Rank").collect()
        want = ranked(sets, sets[0], 0.3)[:top]
        assert [r["Compound_ID"] for r in rows] == [f"c{i}" for i in want]
        assert [r["Rank"] for r in rows] == list(range(1, len(want) + 1))
    kept = S.search(library, to_words(sets[0]), N_BITS, query_smiles="s0", include_query=False).collect()
    assert all(r["SMILES"] != "s0" for r in kept)
    assert S.neighbours(library, to_words(sets[0]), N_BITS, 4, "mcconnaughey").count() == 4


def test_batch_and_blocks(library, sets, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rows = S.batch_search(library.where("row % 5 = 0"), library, N_BITS, threshold=0.2, top=3).collect()
    for q in range(0, len(sets), 5):
        own = sorted((r["Rank"], r["Compound_ID"]) for r in rows if r["Query_ID"] == f"c{q}")
        assert [c for _, c in own] == [f"c{i}" for i in ranked(sets, sets[q], 0.2)[:3]]
    assert S.hit_counts(S.batch_search(library, library, N_BITS, top=2)).agg(F.max("hits")).first()[0] == 2


def test_pairwise(library, sets):
    n = len(sets) + 1
    rows = {(r["i"], r["j"]): r["similarity"] for r in S.pairwise(library, N_BITS, "russel").collect()}
    assert len(rows) == n * n
    assert all(rows[i, i] == 1.0 for i in range(n - 1)) and rows[n - 1, 0] is None
    assert all(rows[i, j] == pytest.approx(rows[j, i]) == pytest.approx(plain("russel", sets[i], sets[j])) for i in range(n - 1) for j in range(i))


def test_pairs_of_the_matrix_meet_once(library, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    matrix = S.pairwise(library, N_BITS, digits=3)
    plan, n = matrix._jdf.queryExecution().optimizedPlan().toString(), library.count()
    assert plan.count("Join ") == 1 and "RepartitionByExpression" in plan
    rows = {(r["i"], r["j"]): r["similarity"] for r in matrix.collect()}
    assert len(rows) == matrix.count() == n * n and all(v is None or v == round(v, 3) for v in rows.values())


@pytest.mark.parametrize(("name", "threshold"), [("tanimoto", 0.5), ("tanimoto", 1.0), ("tanimoto", 0.0), ("dice", 0.6)])
def test_threshold_join(library, sets, name, threshold):
    got = {(r["a_row"], r["b_row"]) for r in S.similar_pairs(library, N_BITS, threshold, name).collect()}
    assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if plain(name, sets[i], sets[j]) >= threshold}


def test_threshold_join_has_no_nested_loop(library):
    plan = S.similar_pairs(library, N_BITS, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_reference_columns(library, sets):
    rows = S.reference_columns(library, library.where("row in (1, 4)"), N_BITS).collect()
    for r in rows:
        if r["fp"] is None:
            assert r["Sim_Ref"] is None
        else:
            best = max((plain("tanimoto", sets[r["row"]], sets[k]), -k) for k in (1, 4))
            assert (r["Sim_Ref"], r["Sim_Ref_BestRef"]) == (pytest.approx(best[0]), f"c{-best[1]}")


def test_diverse(library, sets):
    got = S.diverse(library, N_BITS, 9, seed=0, keep_every=3).orderBy("Pick_Order").collect()
    picks, far = [0], {i: 1 - plain("tanimoto", sets[0], s) for i, s in enumerate(sets) if i}
    want = [(0, 0.0)]
    while len(picks) < 9:
        best = max(far, key=lambda i: (far[i], -i))
        want.append((best, far.pop(best)))
        picks.append(best)
        far = {i: min(d, 1 - plain("tanimoto", sets[best], sets[i])) for i, d in far.items()}
    assert [(r["Compound_ID"], r["Min_Distance"]) for r in got] == [(f"c{i}", pytest.approx(d)) for i, d in want]
    with pytest.raises(ValueError, match="picks of"):
        S.diverse(library, N_BITS, 10_000)
    assert S.diverse(library, N_BITS, 2).count() == 2


def test_leader(library, sets):
    leaders, want = [], {}
    for i, s in enumerate(sets):
        k = next((k for k, j in enumerate(leaders) if plain("tanimoto", sets[j], s) >= 0.6), None)
        if k is None:
            leaders.append(i)
        want[i] = (len(leaders) - 1, True) if k is None else (k, False)
    want[len(sets)] = (-1, False)
    assert {r["row"]: (r["Cluster_ID"], r["Is_Centroid"]) for r in C.leader_clusters(library, N_BITS, 0.6).collect()} == want
    assert {r["Cluster_ID"] for r in C.leader_clusters(library, N_BITS, 0.0).where("Cluster_ID >= 0").collect()} == {0}


def test_butina_and_medoids(library, sets):
    n, t = len(sets), 0.6
    near = {i: {j for j in range(n) if j != i and plain("tanimoto", sets[i], sets[j]) >= t} for i in range(n)}
    order, center = sorted(range(n), key=lambda i: (-len(near[i]), i)), {}
    for i in order:
        if i not in center:
            center[i] = i
            for j in near[i]:
                center.setdefault(j, i)
    sizes = {c: sum(x == c for x in center.values()) for c in set(center.values())}
    ids = {c: k for k, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], order.index(c))), 1)}
    clusters = C.butina_clusters(library, N_BITS, t).cache()
    got = {r["row"]: (r["Cluster_ID"], r["Cluster_Size"]) for r in clusters.collect()}
    assert got == {i: (ids[c], sizes[c]) for i, c in center.items()} | {n: (None, None)}
    rows = {r["Cluster_ID"]: r for r in C.medoids(clusters, library, N_BITS).collect()}
    for c, k in ids.items():
        members = [i for i in range(n) if center[i] == c]
        mean = {i: sum(plain("tanimoto", sets[i], sets[j]) for j in members if j != i) / (len(members) - 1) if len(members) > 1 else 1.0 for i in members}
        assert rows[k]["Cluster_MedoidMeanSim"] == pytest.approx(max(mean.values()))
    with pytest.raises(ValueError, match="between 0 and 1"):
        C.butina_clusters(library, N_BITS, 1.0)


def test_matrix_of_the_whole_table(spark, tmp_path):
    from leadlight.plans.adapters import N_BITS as BITS
    from leadlight.plans.queries import QUERIES

    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], i % 4) for i in range(23)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    on = [{k for k in range(BITS) if v[k] > 0} for _, v, _ in rows]
    got = {(r["i"], r["j"]): r["similarity"] for r in QUERIES["similarity_pairwise"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): 1.0 if i == j else pytest.approx(len(on[i] & on[j]) / len(on[i] | on[j]), abs=1e-8) for i in range(23) for j in range(23)}


def test_cells_of_the_matrix_come_row_by_row(library, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rows = S.pairwise(library, N_BITS, digits=9).collect()
    runs = 1 + sum(a["i"] != b["i"] for a, b in zip(rows, rows[1:]))
    assert len({(r["i"], r["j"]) for r in rows}) == len(rows) and runs < len(rows) / 4
    none = library.where("fp is null").first()["row"]
    assert all((r["similarity"] is None) == (none in (r["i"], r["j"])) for r in rows)


def test_rounding_equals_that_of_decimal_texts(spark):
    values = [c / n for n in range(1, 130) for c in range(-n, n + 1, 1 + n // 40)] + [1 / 1024, 3 / 2048, 0.0000000005, -0.0000000005, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[F.round("v", k).alias(f"a{k}") for k in (3, 9)], *[S._rounded(F.col("v"), k).alias(f"b{k}") for k in (3, 9)])
    assert df.where("not (a3 <=> b3 and a9 <=> b9)").count() == 0
