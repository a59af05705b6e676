"""Range pairs, vector clusters and medoids against plain re-computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlight.operators import blocks, cluster, medoids, ranges

NAN = float("nan")


def clumps(seed, groups, members, dims, noise=0.2):
    rng = np.random.default_rng(seed)
    return [(m + noise * rng.normal(size=dims)).tolist() for m in rng.normal(size=(groups, dims)) for _ in range(rng.integers(1, members))]


def frame(spark, vectors, start=0):
    rows = [(start + i, v) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [NAN] * len(vectors[0])), (903, [None, *vectors[0][1:]]), (None, vectors[0])] if vectors else []
    return spark.createDataFrame(rows + odd, "row long, embedding array<double>")


def plain_pairs(vectors, radius):
    v = np.array(vectors)
    return {(i, j): d for i in range(len(v)) for j in range(i + 1, len(v)) if (d := float(np.sqrt(((v[i] - v[j]) ** 2).sum()))) <= radius}


def test_every_pair_of_a_key_meets_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a" if i < 40 else f"k{i // 3}", i % 2) for i in range(70)], "row long, key string, home int")
    for bound in (100_000, 0):
        monkeypatch.setattr(blocks, "BROADCAST", bound)
        got = [(r["a_row"], r["b_row"]) for r in blocks.pairs_within(rows, ["key"], "row", 8).collect()]
        want = [(i, j) for i in range(70) for j in range(i + 1, 70) if (i < 40) == (j < 40) and (j < 40 or i // 3 == j // 3)]
        assert sorted(got) == want


@pytest.mark.parametrize(("dims", "radius", "crowd"), [(3, 0.4, 4096), (3, 0.4, 8), (8, 0.9, 8), (1, 0.05, 16), (5, 100.0, 16), (4, 0.0, 8)])
def test_range_pairs(spark, monkeypatch, dims, radius, crowd):
    monkeypatch.setattr(ranges, "CROWD", crowd)
    vectors = clumps(dims, 9, 9, dims)
    vectors += [vectors[0], vectors[0], [1e-9 + x for x in vectors[3]]]
    got = {(r["a_row"], r["b_row"]): r["distance"] for r in ranges.range_pairs(frame(spark, vectors), radius).collect()}
    want = plain_pairs(vectors, radius)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_range_pairs_of_sizes_and_nothing(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [0.1]), (3, [0.0, 0.0]), (4, [0.0, 0.1]), (5, [9.0, 9.0, 9.0])], "row long, embedding array<float>")
    assert sorted((r["a_row"], r["b_row"]) for r in ranges.range_pairs(rows, 0.5).collect()) == [(1, 2), (3, 4)]
    assert ranges.range_pairs(frame(spark, []), 1.0).count() == 0


def test_rings_leave_pairs_out(spark, monkeypatch):
    """Far clumps never meet: what is placed as a guest is a small part of all with all."""
    vectors = [(np.array(v) + 50 * (i % 8)).tolist() for i, v in enumerate(np.random.default_rng(1).normal(size=(400, 4)))]
    monkeypatch.setattr(ranges, "CROWD", 8)
    placed, _ = ranges.placed_rows(frame(spark, vectors).where("row < 900 and embedding is not null").select("row", F.col("embedding").alias("v")), 0.5, 400)
    meet = placed.groupBy("ring").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g")).select(F.sum(F.expr("h * (h - 1) / 2 + h * g"))).first()[0]
    assert meet < 0.25 * 400 * 399 / 2


def greedy(n, pairs):
    start = [True] * n
    for a, b in sorted(pairs):
        if start[a]:
            start[b] = False
    return start


@pytest.mark.parametrize("rounds", [0, 2, 16])
def test_greedy_starts(spark, monkeypatch, rounds):
    """Long chains need windows; the result is that of the plain rule."""
    monkeypatch.setattr(cluster, "ROUNDS", rounds)
    monkeypatch.setattr(cluster, "WINDOW", 16)
    rng = np.random.default_rng(rounds)
    chain = [(i, i + 1) for i in range(60)]
    more = [(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 90, (80, 2)) if a != b]
    pairs = spark.createDataFrame(chain + more, "before long, after long")
    got = {r["row"]: r["start"] for r in cluster.greedy_starts(spark.range(90).withColumnRenamed("id", "row"), pairs).collect()}
    assert [got[i] for i in range(90)] == greedy(90, set(chain + more))
    assert cluster.greedy_starts(spark.range(0).withColumnRenamed("id", "row"), pairs).count() == 0


def plain_butina(n, pairs):
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    groups, seen = [], set()
    for i in sorted(range(n), key=lambda i: (-len(near[i]), i)):
        if i not in seen:
            groups.append([i, *sorted(near[i] - seen)])
            seen |= {i, *near[i]}
    order = sorted(groups, key=lambda g: -len(g))
    return {i: (k + 1, len(g)) for k, g in enumerate(order) for i in g}


def test_butina_of_vectors(spark):
    vectors = clumps(5, 8, 10, 4)
    got = {r["row"]: (r["Cluster_ID"], r["Cluster_Size"]) for r in cluster.butina_vectors(frame(spark, vectors), 0.6).collect()}
    want = plain_butina(len(vectors), plain_pairs(vectors, 1 / 0.6 - 1))
    assert {i: got[i] for i in want} == want and all(got[i] == (None, None) for i in range(900, 904))
    with pytest.raises(ValueError, match="between"):
        cluster.butina_vectors(frame(spark, vectors), 1.0)


@pytest.mark.parametrize("large", [4, 1000])
def test_vector_medoids(spark, monkeypatch, large):
    monkeypatch.setattr(medoids, "LARGE", large)
    monkeypatch.setattr(medoids, "CROWD", 16)
    vectors = clumps(7, 6, 30, 5, 0.6)
    vectors += [vectors[0]] * 3
    of = [(i, i % 4 if i else None) for i in range(len(vectors))] + [(900, 1), (902, 2)]
    of[-3] = (of[-3][0], 77)  # alone
    clusters = spark.createDataFrame(of, "row long, Cluster_ID int")
    got = {r["Cluster_ID"]: (r["row"], r["Cluster_MedoidMeanSim"]) for r in cluster.vector_medoids(clusters, frame(spark, vectors)).collect()}
    v, want = np.array(vectors), {}
    for k in {c for i, c in of if c is not None and i < 900}:
        mine = [i for i, c in of if c == k and i < 900]
        means = {i: round(float(np.mean([1 / (1 + np.sqrt(((v[i] - v[j]) ** 2).sum())) for j in mine if j != i])), 12) if len(mine) > 1 else 1.0 for i in mine}
        want[k] = min(mine, key=lambda i: (-means[i], i)), max(means.values())
    assert {k: r for k, (r, _) in got.items()} == {k: r for k, (r, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_bounds_rule_members_out(spark, monkeypatch):
    monkeypatch.setattr(medoids, "LARGE", 10)
    rng = np.random.default_rng(3)
    points = [(1, i, x) for i, x in enumerate((rng.normal(size=(300, 2)) * np.where(np.arange(300) < 150, 0.2, 4.0)[:, None]).tolist())]
    rows = spark.createDataFrame([(*p, 300) for p in points], "Cluster_ID int, row long, x array<double>, size long")
    left = medoids._screened(rows, medoids.Vectors())
    v = np.array([x for _, _, x in points])
    means = (1 / (1 + np.sqrt(((v[:, None] - v) ** 2).sum(2)))).sum(1)
    candidates = {r["row"] for r in left.where("candidate").collect()}
    assert int(means.argmax()) in candidates and len(candidates) < 200 and left.count() == 300


@pytest.mark.parametrize("name", ["tanimoto", "dice", "mcconnaughey", "asymmetric", "kulczynski"])
def test_bit_medoids(spark, monkeypatch, name):
    monkeypatch.setattr(medoids, "LARGE", 5)
    rng = np.random.default_rng(11)
    words = [[int(x) for x in rng.integers(-(1 << 62), 1 << 62, 2) & rng.integers(-(1 << 62), 1 << 62, 2)] for _ in range(60)] + [[0, 0], [0, 0], [-1, -1]]
    library = spark.createDataFrame([(i, f"c{i}", f"s{i}", w) for i, w in enumerate(words)] + [(99, "bad", "s", None)], "row long, Compound_ID string, SMILES string, fp array<long>")
    clusters = library.select("row", (F.col("row") % 3).cast("int").alias("Cluster_ID"))
    got = {r["Cluster_ID"]: (r["Cluster_Representative_ID"], round(r["Cluster_MedoidMeanSim"], 9)) for r in cluster.medoids(clusters, library, 128, name).collect()}
    sets = [{b for w, x in enumerate(ws) for b in range(64) if (x >> b) & 1 for b in [b + 64 * w]} for ws in words]

    def plain(a, b):
        x, y, c = len(a), len(b), len(a & b)
        if name == "tanimoto":
            return c / len(a | b) if a | b else 0.0
        if name == "dice":
            return 2 * c / (x + y) if x + y else 0.0
        if name == "asymmetric":
            return c / x if x else 0.0
        if name == "kulczynski":
            return (c / x + c / y) / 2 if x and y else 0.0
        return (c * c - (x - c) * (y - c)) / (x * y) if x * y else 0.0

    for k in range(3):
        mine = [i for i in range(len(words)) if i % 3 == k]
        means = {i: round(sum(plain(sets[i], sets[j]) for j in mine if j != i) / (len(mine) - 1), 12) for i in mine}
        best = min(mine, key=lambda i: (-means[i], i))
        assert got[k] == (f"c{best}", round(means[best], 9))


def test_guests_of_a_ring_meet_its_own_rows_only(spark, monkeypatch):
    monkeypatch.setattr(ranges, "CROWD", 8)
    clean = frame(spark, clumps(2, 12, 40, 2)).where("row < 900 and embedding is not null").select("row", F.col("embedding").alias("v"))
    n = clean.count()
    for radius, narrow in ((0.3, True), (1e6, False)):
        placed, _ = ranges.placed_rows(clean, radius, n)
        met = ranges._meetings(placed, n).groupBy("ring", "i", "j").agg(F.count_if("home").alias("own")).collect()
        assert all(m["own"] for m in met) and (len({m["ring"] for m in met}) > 1) == narrow


def test_butina_of_vectors_lists_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(cluster, "greedy_starts", None)
    vectors = clumps(6, 4, 8, 3)
    got = {r["row"]: (r["Cluster_ID"], r["Cluster_Size"]) for r in cluster.butina_vectors(frame(spark, vectors), 0.6).collect()}
    want = plain_butina(len(vectors), plain_pairs(vectors, 1 / 0.6 - 1))
    assert {i: got[i] for i in want} == want
