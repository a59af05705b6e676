"""Exact top-k, license scans and near duplicates against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("leadlight.llm")

from leadlight.llm import licenses, neardup, topk  # noqa: E402
from leadlight.llm.words import WINDOW  # noqa: E402


def test_top_k_against_all(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "STEP", 8)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 6)).round(1).astype(np.float32).tolist()  # rounded: ties
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0, None] + [0.0] * 4), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (304, vectors[5]), (305, [1.0, 2.0]), (400, [0.5, 0.5]), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10).collect())
    whole = {i: [int(np.floor(float(x) * 1024)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:10], 1)]
    assert got == sorted(want)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_license_phrases_against_pattern(spark):
    texts = ["The MIT License.", "mit-LICENSE mit license", "permit license", "GNU General\nPublic License!", "gnu general public licenses", "cc by cc by cc", None, "", "…", "ÉMIT license", "Apache  License, mit license"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    for r in licenses.scan(df).collect():
        lower = "".join(c.lower() if c < "\x80" else c for c in texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        want = sorted((label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert r["n_words"] == len(words)
        assert sorted((p["label"], p["word"]) for p in r["places"]) == want
        assert 0 <= r["score"] <= 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_notices_are_found_within_their_edits():
    rng = random.Random(4)
    for text in licenses.NOTICES:
        notice = licenses.Notice(text, "x")
        for _ in range(20):
            damaged = list(text)
            for _ in range(notice.edits):
                at = rng.randrange(len(damaged))
                rng.choice([lambda at=at: damaged.__setitem__(at, "q"), lambda at=at: damaged.pop(at), lambda at=at: damaged.insert(at, "q")])()
            spans = notice.spans(f"some words {''.join(damaged)} and more".encode())
            assert spans
            assert all(0 <= e <= notice.edits for _, _, e in spans)
    assert licenses.Notice("mit license", "mit").spans(b"a text without any notice at all") == []


def test_neighbouring_notices_against_brute_force():
    mit = licenses.Notice("mit license", "mit")
    assert [x[:2] for x in mit.spans(b"mit licence mit license")] == [(0, 11), (12, 23)]
    assert len(mit.spans(b"the mit licence or the mit license or mit licens x")) == 3
    rng = random.Random(7)
    for text in ("mit license", "apache license", "licensed under cc by", "gnu general public license"):
        notice = licenses.Notice(text, "x")
        for _ in range(15):
            parts = []
            for _ in range(rng.randint(2, 6)):
                damaged = list(text)
                for _ in range(rng.randint(0, notice.edits + 1)):
                    at = rng.randrange(len(damaged))
                    rng.choice([lambda at=at: damaged.__setitem__(at, "q"), lambda at=at: damaged.pop(at), lambda at=at: damaged.insert(at, "q")])()
                parts.append("".join(damaged))
            words = rng.choice([" ", " or ", ""]).join(parts)
            spans = notice.spans(words.encode())
            assert all(edits(text, words[a:b]) == e <= notice.edits for a, b, e in spans)
            borders = [0, *[x for a, b, _ in spans for x in (a, b)], len(words)]
            assert borders == sorted(borders)
            # nothing that matches is left before, between or behind the spans
            for lo, hi in zip(borders[::2], borders[1::2], strict=True):
                for a in range(lo, hi):
                    for b in range(a + notice.size - notice.edits, min(hi, a + notice.size + notice.edits) + 1):
                        borders = (a == 0 or words[a - 1] == " ") and (b == len(words) or words[b] == " ")
                        assert not borders or edits(text, words[a:b]) > notice.edits, (words, spans, a, b)
            assert all((a == 0 or words[a - 1] == " ") and (b == len(words) or words[b] == " ") for a, b, _ in spans)


def test_no_notice_inside_words(spark):
    mit = licenses.Notice("mit license", "mit")
    for words in (b"submit license", b"permit license", b"limit license", b"emit licence", b"mit licenses here"):
        assert [e for _, _, e in mit.spans(words)] == ([1] if words.endswith(b"here") else [])
    rows = [(1, "permit license " * 5), (2, "x" * 2_000_000 + " MIT-License"), (3, "mit license " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(df).selectExpr("doc_id", "size(places) p", "size(spans) s", "score").collect()}
    assert [tuple(out[i])[1:] for i in (1, 2, 3)] == [(0, 0, 0.0), (1, 1, 1.0), (100_000, 100_000, 1.0)]
    assert licenses.scan(df.limit(0)).count() == 0


def brute(rows, least=0.8):
    """Classes by weighted or plain Jaccard of all pairs, with exact document frequencies."""
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        if words:
            sets[i] = Counter(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4)))
    df = Counter(s for c in sets.values() for s in c)
    idf = {s: math.log1p(len(sets) / (n + neardup.SMOOTH * len(sets))) for s, n in df.items()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        low = sum(min(n, y[s]) * idf[s] for s, n in x.items() if s in y)
        weighted = low / (sum(n * idf[s] for s, n in x.items()) + sum(n * idf[s] for s, n in y.items()) - low)
        if max(weighted, len(x.keys() & y) / len(x.keys() | y)) >= least:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def copies(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, n = [], 0
    for size in (1, 1, 1, 2, 3, 25):
        base = [word() for _ in range(rng.randint(120, 200))]
        for k in range(size):
            own = list(base)
            for _ in range(0 if k == 0 else rng.choice([0, 1, 2, 3, 12])):
                own[rng.randrange(len(own))] = word()
            rows.append((n, " ".join(own)))
            n += 1
    return rows + [(n, "One Two"), (n + 1, "one  two"), (n + 2, ""), (n + 3, None), (n + 4, " \n"), (n + 5, "one two three four five six")]


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_against_all_pairs(spark, seed):
    rows = copies(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    wrong = [i for i in got if got[i] != want[i]]
    assert len(wrong) <= 1, wrong  # at a similarity of just 0.8 a pair may share no band


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text.upper()), (8, "other words here")], "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["class_size"]) for r in rows) == [(0, 5, 4), (5, 5, 4), (5, 5, 4), (7, 5, 4), (8, 8, 1)]
    kept = sorted((r["doc_id"] or 0) for r in neardup.one_of_each(df).collect())
    assert kept == [5, 8]
    kept = neardup.one_of_each(df.where("doc_id is null or doc_id = 8").withColumn("doc_id", F.expr("nullif(doc_id, 8)"))).collect()
    assert sorted(r["text"] for r in kept) == ["other words here", text]


def test_nothing_to_compare(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sampling_estimates_similarity():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    parts = [np.sort(np.concatenate([shared, x])) for x in (a, b)]
    sets = neardup.Sets(np.concatenate(parts), np.ones(1600, np.int64), np.array([0, 800, 1600]), [])
    weight = 1 + (sets.hashes % np.uint64(5)).astype(float)
    true = neardup.similarities((parts[0], weight[:800]), sets, weight, 1, 2)[0]
    weighted, plain = neardup.signatures(sets, weight)
    assert true >= 0.6 and abs((weighted[0] == weighted[1]).mean() - true) < 0.15
    assert abs((plain[0] == plain[1]).mean() - 0.6) < 0.15


def test_words_by_windows(monkeypatch):
    """Texts of megabytes and words longer than a window hash like their parts elsewhere."""
    rng = random.Random(5)
    words = [b"".join(rng.choice([b"a", b"Zz", "ж".encode()]) for _ in range(rng.choice([1, 3, 9, 700]))) for _ in range(3000)]
    long = b"Q" * (WINDOW // 2) + b"x"
    words[100], words[2000], words[2001] = long, long * 5, long
    text = b"".join(w + rng.choice([b" ", b"\n\t "]) for w in words)
    assert len(text) > 4 * WINDOW
    own = {w: neardup.word_hashes(w + b" ")[1][0] for w in set(words)}
    assert neardup.word_hashes(text)[1].tolist() == [own[w] for w in words]
    assert own[long] == neardup.word_hashes(long.lower() + b" ")[1][0] and len(set(own.values())) == len(own)
    sets = neardup.shingled([text, b"", b" \n", b"one", text.lower()])
    assert np.diff(sets.offsets).tolist() == [2996, 0, 0, 1, 2996] and sets.node(0) == sets.node(4)


def test_long_texts_among_short_ones(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    long = [word() for _ in range(400_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-30_000], *(word() for _ in range(30_000))])), (3, " ".join(long[:250_000])), (4, "short"), (5, "x" * 3_000_000), (6, "X" * 3_000_000)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}


@pytest.mark.parametrize(("rows", "share", "edited"), [(360, 3, 3), (300, 10, 5)])
def test_large_group_against_plain_jaccard(spark, rows, share, edited):
    rng = random.Random(rows)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base = [word() for _ in range(300)]
    texts = []
    for k in range(rows):
        own = list(base) if k < rows // share else [word() for _ in range(300)]
        if k < rows // share:
            for at in rng.sample(range(300), edited):
                own[at] = word()
        texts.append(own)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(rows))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(rows):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(rows)}


def test_blocks_of_one_band(spark, monkeypatch):
    """One band of all nodes, in blocks of two: what the hub does not reach is found by blocks, chains of links included."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    base, texts = [word() for _ in range(100)], []
    for _ in range(4):
        texts.append(" ".join(base))
        at = rng.randrange(50)
        base = [*base[:at], word(), *base[at + 1 :], word()]
    texts += [" ".join(word() for _ in range(n)) for n in (90, 100, 110, 400)]
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 2)
    sketched = neardup.sketched
    one_band = lambda *args: sketched(*args).withColumn("bands", F.array(F.lit(7).cast("long"), *[F.xxhash64("node", F.lit(i)) for i in range(1, 2 * neardup.BANDS)]))
    monkeypatch.setattr(neardup, "sketched", one_band)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(list(enumerate(texts)))
    assert {want[i] for i in range(4)} == {0}
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == want


def near_pair():
    base = [f"w{i}" for i in range(100)]
    return " ".join(base), " ".join([*base[:-1], "other"])


def test_near_copies_without_ids(spark):
    first, second = near_pair()
    df = spark.createDataFrame([(None, first), (None, second), (3, "something else")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_size"]) for r in neardup.near_duplicates(df).collect()) == [(0, 2), (0, 2), (3, 1)]


def test_different_texts_with_one_id(spark):
    first, second = near_pair()
    own = " ".join(f"x{i}" for i in range(60))
    rows = [(3, first), (5, second), (5, own), (5, own + " "), (7, " "), (7, own + " more words"), (9, ""), (9, ""), (11, "one text"), (11, "two texts")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"].strip()) for r in neardup.one_of_each(df).collect())
    assert kept == sorted([(3, first), (5, own), (7, ""), (9, ""), (9, ""), (11, "one text"), (11, "two texts")])
    repeated = neardup.one_of_each(spark.createDataFrame([(5, own, 1), (5, own, 2)], "doc_id long, text string, __id int")).collect()
    assert len(repeated) == 1
