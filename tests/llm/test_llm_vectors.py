"""Near-duplicate vectors, centroid clustering and hard negatives against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("leadlight.llm")

from leadlight.llm import centroids, hard_negatives, vector_dups  # noqa: E402

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id int, n string, v int, cluster string, list int"


def frame(spark, rows):
    """Rows (id, vector, label) with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


def f32(vector):
    return np.array(vector, np.float32).astype(float)


def odd_rows(start, dims):
    """Rows that take no part, and one of another size."""
    one = [1.0] * dims
    return [(start, None, 1), (start + 1, [], 1), (start + 2, [None, *one[1:]], 1), (start + 3, [NAN, *one[1:]], 1), (start + 4, [INF, *one[1:]], 1), (start + 5, [0.0] * dims, 1), (start + 6, one, None), (start + 7, [1.0, 1.0], 1), (start + 8, [2.0, 2.0], 1)]


# ---- near duplicates ------------------------------------------------------------------------------


def plain_classes(rows, least):
    """[(id, n_links, component_id)] in the order of the rows."""
    able = [v is not None and len(v) > 0 and i is not None and k is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, k in rows]
    linked = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if able[a] and able[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = f32(rows[a][1]), f32(rows[b][1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    linked[a].append(b)
                    linked[b].append(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], len(linked[a]), min(ids) if ids else None))
    return out


def clumps(seed, groups, members, dims, noise):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        middle = rng.normal(size=dims)
        for m in range(rng.integers(1, members)):
            spread = noise * rng.choice([0.0, 0.3, 1.0, 2.0])
            out.append((middle + spread * rng.normal(size=dims)) * rng.choice([0.01, 1.0, 30.0]))
    return out


def in_order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("dims", "crowd", "broadcast"), [(20, 4096, 100_000), (20, 8, 100_000), (20, 8, 0), (3, 16, 100_000), (1, 8, 100_000)])
def test_vector_classes_against_all_pairs(spark, monkeypatch, dims, crowd, broadcast):
    monkeypatch.setattr(vector_dups, "BROADCAST", broadcast)
    vectors = clumps(dims, 12, 9, dims, 0.2)
    rows = [(i, v.tolist(), int(i % 7 == 0)) for i, v in enumerate(vectors)]
    rows += [(500, rows[3][1], rows[3][2]), (500, rows[3][1], rows[3][2]), (501, rows[3][1], 5), (2, rows[9][1], rows[9][2]), (None, rows[3][1], 0), *odd_rows(600, dims)]
    got = vector_dups.vector_classes(frame(spark, rows), 0.98, crowd).collect()
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)
    assert in_order((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == in_order(plain_classes(rows, 0.98))


def test_vector_classes_of_many_copies(spark):
    """A hot group: copies in thousands are one node, near copies meet in chunks."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=16)
    rows = [(i, middle.tolist(), 1) for i in range(2000)]
    rows += [(2000 + i, (middle + 0.05 * rng.normal(size=16)).tolist(), 1) for i in range(150)]
    got = {r["vec_id"]: r for r in vector_dups.vector_classes(frame(spark, rows), 0.98, crowd=16).collect()}
    want = dict(zip(range(2000, 2150), plain_classes(rows[1999:], 0.98)[1:], strict=True))
    to_copy = {i: f32(rows[i][1]) @ f32(middle) / np.sqrt(f32(rows[i][1]) @ f32(rows[i][1]) * (f32(middle) @ f32(middle))) >= 0.98 for i in want}
    assert all(got[i]["n_links"] == n + 1999 * to_copy[i] for i, (_, n, _) in want.items())
    assert all(got[i]["n_links"] == 1999 + sum(to_copy.values()) and got[i]["component_id"] == 0 for i in range(2000))


def test_vector_classes_by_a_double_column(spark):
    rows = [(1, [1.0, 1e-9], "a"), (2, [1.0, 0.0], "a"), (3, [1e200, 0.0], "a"), (4, [1e-300, 0.0], "a")]
    got = {r["vec_id"]: r["n_links"] for r in vector_dups.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}  # squared lengths beyond a double link with nothing


def test_vector_classes_of_nothing(spark):
    out = vector_dups.vector_classes(frame(spark, []))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0
    assert vector_dups.vector_classes(frame(spark, odd_rows(0, 4)[:7])).where("n_links = 0 and kept").count() == 7


def test_every_pair_is_judged_once():
    """Over all blocks, each linked pair is counted in exactly one, whatever the blocks find."""
    rng = np.random.default_rng(0)
    vectors = np.array(clumps(1, 10, 8, 24, 0.25))
    n, total = len(vectors), 0
    for block in range(3):
        count, _ = vector_dups.links_within(vectors, np.ones(n, bool), np.zeros(n, int), np.ones(n, int), block, 0.97)
        total += count.sum()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    assert total == (unit @ unit.T >= 0.97).sum() - n
    turn = vector_dups.rotation(24)
    assert np.allclose(turn @ turn.T, np.eye(24))
    some = vectors[rng.permutation(n)[:5]]
    assert (vector_dups.rotated(vectors, turn)[:1] == vector_dups.rotated(vectors[:1], turn)).all() and vector_dups.rotated(some, turn).shape == (5, 24)


# ---- centroid clustering --------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale=1024):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)
    middle = [v for _, _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(middle)):
            of = [v for (_, v), c in zip(kept, at, strict=True) if c == j]
            if of:
                middle[j] = [sum(column) // len(of) for column in zip(*of, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return [(i, c, d, sum(x for _, e, x in found if e == c), sum(x for _, _, x in found), digest[c]) for i, c, d in found]


@pytest.mark.parametrize(("dims", "n", "k"), [(6, 200, 8), (5, 3, 8), (9, 120, 1), (64, 60, 5)])
def test_clusters_against_plain(spark, dims, n, k):
    rng = np.random.default_rng(n)
    rows = [(i, (0.01 * rng.integers(-3, 4, dims) + (i % 5)).tolist(), 1) for i in range(n)]  # many ties
    rows += [(0, rows[0][1], 1), (1, rows[2][1], 1), (None, rows[1][1], None), *odd_rows(900, dims)]
    got = [tuple(r)[:6] for r in centroids.cluster(frame(spark, rows), k=k, rounds=4, dims=dims).collect()]
    assert in_order(got) == in_order(plain_clusters(rows, k, 4, dims))


def test_empty_centroids_stay(spark):
    """Equal starts: all rows go to the smaller number, the other stays where it is."""
    rows = [(i, [1.0, 2.0], 1) for i in range(5)] + [(7, [1.0, 2.0], 1), (8, [1.5, 2.0], 1)]
    got = [tuple(r)[:6] for r in centroids.cluster(frame(spark, rows), k=4, rounds=2, dims=2).collect()]
    assert in_order(got) == in_order(plain_clusters(rows, 4, 2, 2))


def test_clusters_of_nothing(spark):
    out = centroids.cluster(frame(spark, odd_rows(0, 4)), dims=64)
    assert out.count() == 0 and out.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(frame(spark, []), dims=4).count() == 0
    assert centroids.cluster(frame(spark, [(None, [1.0], 1)]), dims=1).count() == 0


def test_block_norms_leave_distances_out():
    """Where vectors differ in size or place, bounds screen most centroids; the nearest one is the same."""
    rng = np.random.default_rng(2)
    middles = np.zeros((40, 16))
    for j, row in enumerate(middles):
        row[rng.permutation(16)[:3]] = 500 + 40 * j
    vectors = np.floor(np.repeat(middles, 25, axis=0) + rng.normal(0, 30, (1000, 16))).astype(np.int64)
    middles = middles.astype(np.int64)
    cluster, far, computed = centroids.nearest(vectors, centroids.compressed(vectors), middles)
    every = ((vectors[:, None] - middles) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (far == every.min(1)).all()
    assert computed < 0.1 * every.size


# ---- hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows, step, scale=256, positives=5, negatives=3, window=(50, 95)):
    able = [(i, k, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v, k in rows if i is not None and k is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, k, v in able:
        if i % step == 0:
            anchors[i, len(v)] = min(anchors.get((i, len(v)), (v, k)), (v, k))
    out = []
    for (i, size), (v, k) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, m == k) for j, m, w in able if j != i and len(w) == size)
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and window[0] * -p <= 100 * -s[0] <= window[1] * -p][:negatives]
            out += [(i, j, r, s[1], -p, -s[0]) for r, s in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_hard_negatives_against_plain(spark, monkeypatch, broadcast):
    for name, value in {"LIST_ROWS": 4, "DATA_BLOCK": 24, "ANCHOR_BLOCK": 2, "BROADCAST": broadcast}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 6))
    rows = [(i, (middles[i % 8] + 0.5 * rng.normal(size=6)).round(1).tolist(), int(rng.integers(3))) for i in range(220)]  # rounded: ties
    rows += [(3, rows[4][1], 1), (5, rows[5][1], rows[5][2]), (50, rows[60][1], 2), (None, rows[3][1], 1), (250, [0.5] * 6, 9), *odd_rows(600, 6)]
    rows += [(700 + i, rows[0][1], 2) for i in range(60)]  # a hot list
    got = [tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label")).collect()]
    assert in_order(got) == in_order(plain_negatives(rows, 50))


def test_hard_negatives_by_text_labels(spark):
    rows = [(i, [1.0 + i % 3, float(i % 5)], "ab"[i % 2]) for i in range(40)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), F.col("vec_id") % 10 == 0, F.col("label")).collect()
    assert in_order(tuple(r) for r in got) == in_order(plain_negatives(rows, 10))


def test_hard_negatives_of_nothing(spark):
    for rows in ([], odd_rows(1, 4), [(50, [1.0], 1)]):
        assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_lists_are_skipped(monkeypatch):
    """Bounds leave out lists that are too far or outside the window."""
    rng = np.random.default_rng(0)
    rows = np.repeat(np.eye(16) * 1000, 50, axis=0) + rng.normal(0, 5, (800, 16))
    index = hard_negatives.Index(np.eye(16) * 1000, np.full(16, 60.0), np.zeros(16, np.int32), np.ones(1, np.int32))
    top, low = index.bounds(rows[:5])
    assert (top >= rows[:5] @ (np.eye(16) * 1000).T).all() and ((rows[:5] @ rows.T).reshape(5, 16, 50).max(2) <= top).all() and ((rows[:5] @ rows.T).reshape(5, 16, 50).min(2) >= low).all()
    assert ((top >= low[:, :1].max()).sum(1) == 1).all()
