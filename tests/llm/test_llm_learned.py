"""The learned operators: held-out accuracy, probabilities, edge cases; and the pipeline's stages."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("leadlight.llm")

from leadlight.llm import brown_lm, langid, neardup, quality, words  # noqa: E402
from leadlight.llm.common import in_fold  # noqa: E402
from leadlight.llm.queries import queries  # noqa: E402


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_fold_is_crc32(spark):
    df = spark.range(50).withColumn("f", in_fold("id", 4, 2))
    assert all(r["f"] == (fold(r["id"], 4) == 2) for r in df.collect())


def test_ranking_separates(spark):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(60)).capitalize() + "."
    rows = [(i, prose() if i % 3 else " ".join(f"{w}###" for w in prose().upper().split())) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(1000, None, "x"), (1001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.train_and_score(docs, labels).collect()}
    assert len(out) == 302
    held = [i for i in range(300) if fold(i, 4) == 2]
    assert all(out[i]["held_out"] for i in held)
    assert np.mean([out[i]["predicted"] == int(i % 3 > 0) for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    ranking = quality.train(docs, labels)
    assert {r["doc_id"] for r in quality.accepted(docs, ranking).collect() if r["doc_id"] < 300} == {i for i in range(300) if out[i]["predicted"]} | {i for i in range(300) if i % 3 and ranking.score(np.array([quality.features(dict(rows)[i].encode())]))[0] >= 0.7}
    assert quality.accepted(docs, ranking).columns == docs.columns


def test_ranking_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.train_and_score(docs, none).collect()] == pytest.approx([0.7, 0.7])
    assert quality.train_and_score(docs.limit(0), none).count() == 0


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    endings = {"aa": ["ung", "keit", "sch"], "bb": ["tion", "ing", "the"], "cc": ["ción", "ado", "ñas"]}
    text = lambda lang: " ".join(rng.choice(endings[lang]) + rng.choice("aeiou") + rng.choice(endings[lang]) for _ in range(rng.randint(20, 200)))
    rows = [(i, text(lang), lang) for i in range(240) for lang in [sorted(endings)[i % 3]]]
    more = [(900, None, "aa"), (901, "12 ... 34", "bb"), (902, "", None), (903, text("aa"), None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + more], "doc_id long, text string, lang string, lang_pred string")
    out = {r["doc_id"]: r for r in langid.train_and_predict(docs).collect()}
    held = [(i, lang) for i, _, lang in rows if fold(i, 4) == 2]
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in held]) >= 0.95
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = langid.accepted(docs, langid.train(docs))
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_tables_equal_convolution():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    net = langid.fit(np.concatenate([rows, rows[::-1]]), ["a", "b"] * 6)
    got = net.responses(rows)
    x = net.vectors[rows]
    want = []
    for w in langid.WIDTHS:
        n = langid.WINDOW - w + 1
        patches = np.concatenate([x[:, j : j + n] for j in range(w)], axis=2)
        want.append(np.maximum((patches @ net.filters[w] + net.biases[w]).max(1), 0))
    assert np.allclose(got, np.concatenate(want, 1), atol=1e-4)


def test_no_language_known(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.train_and_predict(docs).collect()] == [("und", 0.0)]
    assert langid.train_and_predict(docs.limit(0)).count() == 0


def words_of(text):
    return [*(text or "").encode().translate(words.LOWER).split(), b""]


def lm_rows():
    rng = random.Random(5)
    return [(i, " ".join(rng.choice(["The", "cat", "DOG", "runs", "sits,", f"rare{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(500, None), (501, ""), (502, "  \t\n"), (503, "É x\x0by\x85z")]


def test_base_scores_against_counts(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CHUNK", 2000)
    rows = lm_rows()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    out = {r["doc_id"]: r for r in brown_lm.score(docs, in_fold("doc_id", 5, 1)).collect()}
    tokens = {i: words_of(t) for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if fold(i, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert set(out) == set(tokens)
    for i, ws in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 5) == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0


def shape(word):
    if any(48 <= c <= 57 for c in word):
        return 1
    return 2 if any(c > 127 for c in word) else 0 if word.isalpha() else 3


def plain_scores(rows, held, heads, least):
    """The class model by dictionaries."""
    train = [words_of(t) for i, t in rows if not held(i)]
    counts = Counter(w for ws in train for w in ws[:-1])
    hashed = {w: int(words.word_hashes(w + b" ")[1][0]) for _, t in rows for w in words_of(t)[:-1]}
    top = sorted(sorted(counts, key=lambda w: (-counts[w], hashed[w]))[:heads], key=hashed.get)
    item = {b"": 0} | {w: brown_lm.FIRST + i for i, w in enumerate(top)}
    pairs = np.zeros((brown_lm.FIRST + len(top),) * 2)
    bigrams = [(a, b) for ws in train for a, b in zip([b"", *ws[:-1]], ws, strict=True)]
    for a, b in bigrams:
        pairs[item.get(a, 1 + shape(a)), item.get(b, 1 + shape(b))] += 1
    of = brown_lm.exchange(pairs, np.arange(brown_lm.FIRST))
    n = brown_lm.FIRST + brown_lm.CLASSES
    table = brown_lm.class_table(pairs, of, n)
    before = {w: int(of[item[w]]) if w in item else 1 + shape(w) for w in {*hashed, b""}}
    after = dict(before)
    for w in counts:
        if counts[w] >= least and w not in item:
            right, left = np.zeros(n), np.zeros(n)
            for a, b in bigrams:
                right[before[b]] += a == w
                left[before[a]] += b == w
            after[w] = brown_lm.best_class(table, before[w], right, left, float(sum(a == b == w for a, b in bigrams)))
    tokens, types, final = np.zeros(n), np.zeros(n), np.zeros((n, n))
    for w, c in (*counts.items(), (b"", len(train))):
        if c:
            tokens[after[w]] += c
            types[after[w]] += 1
    for a, b in bigrams:
        final[after[a], after[b]] += 1
    moves = brown_lm.transitions_of(final)
    counts[b""] = len(train)
    out = {}
    for i, t in rows:
        ws = words_of(t)
        path = [0, *(after[w] for w in ws)]
        out[i] = sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(math.log10((counts[w] + 0.5) / (tokens[c] + 0.5 * (types[c] + 1))) for w, c in zip(ws, path[1:], strict=True))
    return out, after


@pytest.mark.parametrize(("heads", "least", "chunk"), [(512, 10, 2000), (5, 3, 1500), (0, 4, 1 << 20)])
def test_scores_against_dictionaries(spark, monkeypatch, heads, least, chunk):
    for name, value in (("HEADS", heads), ("LEAST", least), ("CHUNK", chunk)):
        monkeypatch.setattr(brown_lm, name, value)
    rng = random.Random(9)
    kinds = [[f"{x}{k}" for k in range(40)] for x in "ab"] + [["the", "of,", "été", "A", "x-y"]]
    draw = lambda j: rng.choices(kinds[j % 3], [1 / (1 + k) for k in range(len(kinds[j % 3]))])[0]
    rows = lm_rows()[::4] + [(1000 + i, " ".join(draw(j) for j in range(rng.randint(0, 20)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in brown_lm.score(docs, in_fold("doc_id", 5, 1)).collect()}
    # the constants that the tasks see are the patched ones, as the plain form's are
    want, classes = plain_scores(rows, lambda i: fold(i, 5) == 1, heads, least)
    assert heads > 5 or sum(c >= brown_lm.FIRST for c in classes.values()) > heads + 5
    assert got == pytest.approx(want)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(6)
    table = rng.integers(0, 5, (9, 9)).astype(float)
    assert np.allclose((10 ** brown_lm.transitions_of(table)).sum(1), 1)
    # a class's words: all seen ones share tokens + types / 2, one unseen word has half a count
    counts = np.array([3, 1, 7, 0])
    share = 10 ** brown_lm.emissions(counts, np.zeros(4, int), np.array([11.0]), np.array([3.0]))
    assert share.sum() == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    # two kinds of words that alternate: the classes find them
    k, n = brown_lm.FIRST, brown_lm.FIRST + 20
    pairs = np.zeros((n, n))
    for i in range(k, n):
        for j in range(k, n):
            if i % 2 != j % 2:
                pairs[i, j] = 10
    pairs[0, k:], pairs[k:, 0] = 1, 1
    of = brown_lm.exchange(pairs, np.arange(k), classes=2)
    assert len(set(of[k::2])) == len(set(of[k + 1 :: 2])) == 1 and of[k] != of[k + 1] and of[:k].tolist() == list(range(k))


def test_long_text_and_common_words(spark):
    """A text of megabytes makes a chunk of its own; a count beyond 16 bits is kept."""
    docs = spark.createDataFrame([(1, "go on " * 500_000), (2, "on go"), (3, "x" * 3_000_000), (4, "go")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in brown_lm.score(docs, F.col("doc_id") == 4).collect()}
    assert [out[i]["n_tokens"] for i in (1, 2, 3, 4)] == [1_000_001, 3, 2, 2] and out[4]["train_tokens"] == 1_000_006
    assert out[4]["base_score"] == pytest.approx(math.log10(500_001.5 / 1_000_008.5) + math.log10(3.5 / 1_000_008.5))
    assert out[2]["score"] > out[3]["score"] - 20 and out[1]["score"] / 1_000_001 > -0.4


def test_words_below_the_heads_have_classes_of_their_own(spark):
    """Two kinds of words alternate; none is frequent, and their endings say nothing."""
    rng = random.Random(11)
    kinds = [["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(600)] for _ in range(2)]
    texts = [" ".join(rng.choice(kinds[j % 2]) for j in range(40)) for _ in range(1500)]
    wrong = [" ".join(sorted(t.split(), key=lambda w: w in kinds[1])) for t in texts[:50]]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(5000 + i, t, True) for i, t in enumerate(texts[:50])] + [(6000 + i, t, True) for i, t in enumerate(wrong)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    out = {r["doc_id"]: r for r in brown_lm.score(docs, F.col("held")).collect()}
    right, other = (np.mean([out[k + i]["score"] for i in range(50)]) / 41 for k in (5000, 6000))
    assert right - other > 1


def likelihood(table):
    x = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0).sum()
    return x(table) - x(table.sum(0)) - x(table.sum(1))


def test_best_class_equals_the_exchange_on_whole_tables():
    rng = np.random.default_rng(12)
    n, first = 30, brown_lm.FIRST
    k = first + 4
    pairs = rng.integers(0, 6, (n, n)).astype(float)
    of = np.array([*range(first), *rng.integers(first, k, n - first)])
    member = lambda x: np.eye(k)[x]
    table = member(of).T @ pairs @ member(of)
    for w in range(first, n):
        values = []
        for c in range(first, k):
            moved = of.copy()
            moved[w] = c
            values.append(likelihood(member(moved).T @ pairs @ member(moved)))
        got = brown_lm.best_class(table, of[w], pairs[w] @ member(of), pairs[:, w] @ member(of), pairs[w, w])
        assert values[got - first] == pytest.approx(max(values))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = brown_lm.score(docs, F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [(1, 0, 0), (3, 0, 0)]
    assert brown_lm.score(docs.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_duplicates", "packing"]
    good = stages["quality"](spark, docs, small)
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) >= 0.95
    spoken = stages["language"](spark, good, small)
    assert spoken.columns == docs.columns and spoken.count() >= 0.98 * len(kept)
    one = stages["near_duplicates"](spark, spoken, small)
    classes = neardup.near_duplicates(spoken).select("class_id").distinct().count()
    assert one.columns == docs.columns and one.count() == classes
    packed = stages["packing"](spark, one, small)
    ids = {r["doc_id"] for r in one.collect()}
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert corpus_pipeline.run(spark, small).select("doc_id").distinct().count() == len(ids)


def test_queries_are_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{n}" for n in range(1, 14)), "media", "pipeline"]


# ---- training against plain loops -----------------------------------------------------------------


def test_pairwise_fit_against_plain_gradients(monkeypatch):
    """The weights are those of a loop over pairs in plain Python, the threshold the one with the fewest errors."""
    monkeypatch.setattr(quality, "PAIRS", 60)
    monkeypatch.setattr(quality, "STEPS", 15)
    rng = np.random.default_rng(2)
    rows, labels = rng.normal(size=(40, 4)), np.array([0, 1] * 20)
    rows[labels == 1, 0] += 1.0
    got = quality.fit(rows, labels, seed=3)
    mean = [sum(r[j] for r in rows) / 40 for j in range(4)]
    scale = [math.sqrt(sum((r[j] - mean[j]) ** 2 for r in rows) / 40) + 1e-3 for j in range(4)]
    x = [[(r[j] - mean[j]) / scale[j] for j in range(4)] for r in rows]
    draw = np.random.default_rng(3)
    pairs = list(zip(draw.choice(np.flatnonzero(labels == 1), 60), draw.choice(np.flatnonzero(labels == 0), 60), strict=True))
    w, first, second = [0.0] * 4, [0.0] * 4, [0.0] * 4
    for step in range(1, 16):
        slope = [quality.RIDGE * v for v in w]
        for better, worse in pairs:
            d = [a - b for a, b in zip(x[better], x[worse], strict=True)]
            lost = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, w, strict=True))))
            slope = [s - lost * v / 60 for s, v in zip(slope, d, strict=True)]
        for j in range(4):
            first[j] = 0.9 * first[j] + 0.1 * slope[j]
            second[j] = 0.99 * second[j] + 0.01 * slope[j] ** 2
            w[j] -= 0.1 * (first[j] / (1 - 0.9**step)) / (math.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
    assert got.weights == pytest.approx(w, rel=1e-9)
    strengths = [sum(a * b for a, b in zip(r, w, strict=True)) for r in x]
    errors = lambda t: sum((s > t) != (y == 1) for s, y in zip(strengths, labels, strict=True))
    assert errors(got.threshold) == min(errors(t) for t in [*strengths, min(strengths) - 1])
    assert quality.Ranking.score(got, rows)[0] == pytest.approx(1 / (1 + math.exp(-(strengths[0] - got.threshold)) * (1 - quality.CUT) / quality.CUT), rel=1e-6)


def test_features_against_plain_counts():
    rng = random.Random(4)
    for data in (b"", b"\n\n", b"word", ("Aa 1\n. é$ aa aa\n" * 3).encode(), bytes(rng.choice(b"ab A1.\n\xc3\xa9") for _ in range(3_000_000))):
        got, n = quality.features(data), len(data)
        counts = Counter(data)
        shares = [sum(counts[b] for b in g) / n if n else 0.0 for g in quality.GROUPS]
        words, lines = data.split(), [x for x in data.split(b"\n") if x]
        more = [len(set(words)) / max(len(words), 1), min(1.0, len(set(words)) / max(len(words), 1) ** 0.75), sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1), len(set(lines)) / max(len(lines), 1)]
        more += [math.log(1 + len(words)) / 10, min(n / max(len(words), 1), 40) / 40, min(n / max(len(lines), 1), 2000) / 2000, float(len(words) < 5)]
        assert got == pytest.approx([*shares, *(min(50 * s, 1) for s in shares), *(more if n else [0.0] * 8)], rel=1e-9)


def test_network_steps_against_plain_convolution(monkeypatch):
    """One pass over two windows: the slopes of every parameter are those of finite differences of the loss."""
    monkeypatch.setattr(langid, "WINDOW", 12)
    monkeypatch.setattr(langid, "PASSES", 1)
    monkeypatch.setattr(langid, "STEP", 4)
    rng = np.random.default_rng(1)
    rows, labels = rng.integers(0, 5, (4, 12)).astype(np.uint8), ["a", "b", "b", "b"]
    trained = langid.fit(rows, labels, seed=5)
    monkeypatch.setattr(langid, "PASSES", 0)
    start = langid.fit(rows, labels, seed=5)
    weight = {"a": 4 / 1 / 2, "b": 4 / 3 / 2}

    def loss(net):
        total = 0.0
        for row, y in zip(rows, labels, strict=True):
            hidden = []
            for width, filters in net.filters.items():
                best = [max(sum(net.vectors[row[p + j]] @ filters[j * langid.VECTOR : (j + 1) * langid.VECTOR][:, f] for j in range(width)) + net.biases[width][f] for p in range(12 - width + 1)) for f in range(langid.FILTERS)]
                hidden += [max(b, 0.0) for b in best]
            logits = np.array(hidden) @ net.out + net.out_bias
            total += weight[y] * (np.log(np.exp(logits).sum()) - logits[net.languages.index(y)]) / 4
        return total + 0.5e-4 * (net.out**2).sum()

    # the first step of this rule moves each parameter by 0.01 against the sign of its slope
    parts = [(start.vectors, trained.vectors), (start.out, trained.out), (start.out_bias, trained.out_bias), *[(start.filters[w], trained.filters[w]) for w in langid.WIDTHS], *[(start.biases[w], trained.biases[w]) for w in langid.WIDTHS]]
    for before, after in parts:
        for at in rng.permutation(before.size)[:12]:
            flat, kept = before.reshape(-1), before.reshape(-1)[at]
            flat[at] = kept + 1e-5
            high = loss(start)
            flat[at] = kept - 1e-5
            slope = (high - loss(start)) / 2e-5
            flat[at] = kept
            moved = after.reshape(-1)[at] - kept
            assert moved == pytest.approx(-0.01 * np.sign(slope) if abs(slope) > 1e-6 else moved, abs=1e-4)
            assert abs(slope) > 1e-6 or abs(moved) <= 0.01 + 1e-9


def test_languages_are_bounded(spark):
    words = {"a": "aba baa", "b": "bcd dcb", "c": "xyz zyx", "d": "kkk lll"}
    rows = [(i, words[k] * 30, k) for i, k in enumerate("aaaaabbbbcccd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, languages=2).languages == ["a", "b"] and langid.train(docs, languages=3).languages == ["a", "b", "c"]


ODD = [(1, None, "en"), (2, "", "en"), (3, "1234 ... 5678", None), (4, "a sentence of plain words that says little but is whole. " * 40_000, "en"), (5, "a short plain sentence of words.", "en"), (5, "a short plain sentence of words.", "en"), (None, "no number but a sentence of words.", None), (6, "one more sentence with some words in it, and then some.", "de")]


def test_stages_keep_columns_and_survive_odd_rows(spark, small):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names; and nothing at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, id string, data string, `c0` int, node string, root int"
    docs = spark.createDataFrame([(*r, "x", None, 1, "n", 2) for r in ODD], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}, name
        assert stage(spark, docs.limit(0), small).count() == 0
    kept = [tuple(r)[:2] for r in corpus_pipeline.keep_one_copy(spark, docs, small).collect()]
    assert len(kept) == len(ODD) - 1 and kept.count((5, ODD[4][1])) == 1  # texts without words stay, of repeated rows one
    pieces = corpus_pipeline.pack_sequences(spark, docs, small).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r[0] for r in ODD)
    assert all(r["length"] <= 2048 for r in pieces) and corpus_pipeline.pack_sequences(spark, docs.limit(0), small).count() == 0


def test_pipeline_of_nothing(spark, small, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
