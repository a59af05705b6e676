"""The stored index, references, and prefix-filter joins against plain re-computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlight.functions.similarity import METRICS
from leadlight.operators import index, prefix
from leadlight.operators import search as S
from leadlight.sources.smiles import read_smiles

N_BITS = 130


def to_words(bits):
    out = [sum(1 << (b - 64 * w) for b in bits if b // 64 == w) for w in range(3)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def plain(name, a, b):
    x, y, c, n = len(a), len(b), len(a & b), N_BITS
    ratio = lambda p, q: p / q if q else 0.0
    return {
        "tanimoto": ratio(c, x + y - c), "dice": ratio(2 * c, x + y), "cosine": ratio(c, (x * y) ** 0.5), "sokal": (n - x - y + 2 * c) / n, "russel": c / n,
        "kulczynski": (ratio(c, x) + ratio(c, y)) / 2 if x and y else 0.0, "mcconnaughey": ratio(c * c - (x - c) * (y - c), x * y), "asymmetric": ratio(c, x), "braun_blanquet": ratio(c, max(x, y)),
    }[name]


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(3)
    out = []
    for size in (4, 10, 25, 60, 100):
        for _ in range(5):
            base = set(rng.sample(range(N_BITS), size))
            out += [base, *[base ^ {rng.randrange(N_BITS) for _ in range(rng.randint(0, 5))} for _ in range(rng.randint(0, 7))]]
    return [*out, set(), set(range(N_BITS)), set(out[0])]


@pytest.fixture(scope="module")
def library(spark, sets):
    rows = [(i, f"c{i}", f"s{i % 50}", to_words(s)) for i, s in enumerate(sets)] + [(len(sets), "bad", "zz", None)]
    return spark.createDataFrame(rows, "row long, Compound_ID string, SMILES string, fp array<long>").cache()


@pytest.mark.parametrize("name", list(METRICS))
def test_index_search_is_exact(library, sets, monkeypatch, name):
    for k, v in {"BLOCK": 4, "QUERIES": 5, "NAMED": 3 if name == "dice" else 1000, "BROADCAST": 0 if name == "cosine" else 1 << 20}.items():
        monkeypatch.setattr(index, k, v)
    found = index.build_index(library, N_BITS)
    threshold = None if name in ("mcconnaughey", "tanimoto") else 0.2
    hits, visited = found.search(library.where("row % 4 = 0 or row >= 30"), name, threshold, 3)
    got = {}
    for r in hits.collect():
        got.setdefault(r["a_row"], []).append((r["Rank"], r["b_row"], round(r["similarity"], 9)))
    for q, s in enumerate(sets):
        if q % 4 == 0 or q >= 30:
            scored = sorted((-round(plain(name, s, t), 9), i) for i, t in enumerate(sets) if threshold is None or plain(name, s, t) >= threshold)[:3]
            assert sorted(got.get(q, [])) == [(k, i, -v) for k, (v, i) in enumerate(scored, 1)]
    if name == "tanimoto":
        assert visited.agg(F.avg("visited")).first()[0] < 0.6 * found.blocks.count()


def test_index_is_stored(spark, library, tmp_path):
    index.build_index(library, N_BITS, str(tmp_path / "index"))
    again = index.load_index(spark, str(tmp_path / "index"))
    assert again.n_bits == N_BITS and again.rows.count() == library.where("fp is not null").count()
    direct = S.batch_search(library.where("row < 9"), library, N_BITS, top=4, include_query=False)
    stored = S.batch_search(library.where("row < 9"), again, N_BITS, top=4, include_query=False)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, stored.collect()))
    assert stored.where("SMILES = Query_SMILES").count() == 0


def test_index_of_nothing(library):
    hits, visited = index.build_index(library.where("false"), N_BITS).search(library)
    assert hits.count() == 0 and visited.count() == 0


def test_references(spark, library, sets, tmp_path):
    (tmp_path / "refs.csv").write_text("Compound_ID,SMILES\nmine,s3\nother,unknown\n")
    refs = S.references(library, ids=["c7", "c2"], smiles=["s1", "none"], file=str(tmp_path / "refs.csv"))
    assert sorted(r["Compound_ID"] for r in refs.collect()) == ["c2", "c7", "mine", "ref_1"] and refs.select("row").distinct().count() == 4
    made = S.references(library, smiles=["x"], fingerprint=lambda rows: rows.withColumn("fp", F.array(*[F.lit(x) for x in to_words({1, 2})])))
    assert made.first()["fp"] == to_words({1, 2})
    with pytest.raises(ValueError, match="no such reference: c999"):
        S.references(library, ids=["c999", "c1"])
    with pytest.raises(ValueError, match="give reference"):
        S.references(library)
    out = {r["row"]: r for r in S.reference_columns(library, refs, N_BITS).collect()}
    assert len(out) == len(sets) + 1 and out[len(sets)]["Sim_Ref"] is None
    known = {r["Compound_ID"]: (r["row"], r["fp"]) for r in refs.collect()}
    for i, s in enumerate(sets):
        best = min((-round(plain("tanimoto", s, {b for b in range(N_BITS) if (fp[b // 64] >> (b % 64)) & 1}), 12), row, name) for name, (row, fp) in known.items())
        assert (round(out[i]["Sim_Ref"], 12), out[i]["Sim_Ref_BestRef"]) == (-best[0], best[2])


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_similar_pairs(library, sets, monkeypatch, threshold):
    monkeypatch.setattr(prefix, "CROWD", 8)
    got = {(r["a_row"], r["b_row"]) for r in S.similar_pairs(library, N_BITS, threshold).collect()}
    assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (sets[i] or sets[j]) and plain("tanimoto", sets[i], sets[j]) >= threshold}


@pytest.mark.parametrize(("name", "threshold"), [("tanimoto", 0.5), ("tanimoto", 0.9), ("dice", 0.7), ("cosine", 0.8), ("cosine", 1.0), ("dice", 1.0)])
@pytest.mark.parametrize("crowd", [5, 4096])
def test_similar_counts(spark, monkeypatch, name, threshold, crowd):
    monkeypatch.setattr(prefix, "CROWD", crowd)
    rng = random.Random(5)
    base = [{rng.choice("abcdefghij") * rng.randint(1, 3): rng.randint(1, 9) for _ in range(rng.randint(1, 6))} for _ in range(12)]
    maps = [{**m, "common": 1 + i % 2} for m in base for i in range(rng.randint(1, 5))] + [{"x": 0}, {}, None, {"common": 2}, {"common": 2}, {"x": -1, "a": 3}]
    df = spark.createDataFrame(list(enumerate(maps)), "row long, counts map<string, int>")
    clean = {i: {k: n for k, n in (m or {}).items() if n > 0} for i, m in enumerate(maps)}

    def value(a, b):
        low = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
        if name == "cosine":
            return float(np.dot([a.get(k, 0) for k in {*a, *b}], [b.get(k, 0) for k in {*a, *b}])) / (np.sqrt(sum(x * x for x in a.values())) * np.sqrt(sum(x * x for x in b.values())))
        return low / (sum(a.values()) + sum(b.values()) - low) if name == "tanimoto" else 2 * low / (sum(a.values()) + sum(b.values()))

    got = {(r["a_row"], r["b_row"]): r["similarity"] for r in S.similar_counts(df, threshold, name).collect()}
    want = {(i, j): value(clean[i], clean[j]) for i in clean for j in clean if i < j and clean[i] and clean[j]}
    certain = {p for p, v in want.items() if v >= threshold + 1e-9}
    assert certain <= got.keys() <= {p for p, v in want.items() if v >= threshold - 1e-9} and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "l.smi").write_text("".join(f"C{'C' * (i % 7)} name{i}\n" if i % 5 else "\n" for i in range(1, 3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_smiles(spark, str(tmp_path / "l.smi"), "similarity").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r["Compound_ID"] == f"name{r['row']}" for r in rows) and len(rows) == sum(i % 5 > 0 for i in range(1, 3000))
