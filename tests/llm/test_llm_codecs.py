"""BPE, token counts, packing and media against the tokenizers library, round trips and brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("leadlight.llm")
tokenizers = pytest.importorskip("tokenizers")

from leadlight.llm import bpe, media, packing, token_counts  # noqa: E402
from leadlight.llm.queries import tokenizer_path  # noqa: E402

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a ", "a  b", "a\n b", " a", "\n\n", "\x1c\x85x", "<|endoftext|>", "x <|endoftext|> y<|startoftext|>", "ΑΣ Σ", "İstanbul", "é é", "日本 🙂", "a" * 3000, "!" * 700 + "?", "don't we'll", "\x00"]
ROWS = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "  a", "x"), (None, "null id", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty texts, repeated rows, and columns whose names the operators use inside."""
    return spark.createDataFrame(ROWS, "doc_id long, text string, ids string")


def library(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def test_bpe_is_exact(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"]), r["decoded"]) for r in bpe.encode_decode(docs, WORD).collect())
    ids, t = library(WORD, [x for _, x, _ in ROWS])
    want = sorted((d is None, d or 0, i, t.decode(i, skip_special_tokens=False)) for (d, _, _), i in zip(ROWS, ids, strict=True))
    assert got == want


def test_counts_are_exact(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, BYTE).collect())
    ids, _ = library(BYTE, [x for _, x, _ in ROWS])
    assert got == sorted((d is None, d or 0, len((x or "").encode()), len(i)) for (d, x, _), i in zip(ROWS, ids, strict=True))


def test_long_units_are_not_kept(spark):
    """Texts of megabytes without spaces: right, and no cache grows by them."""
    long = "字" * 300_000 + "ab" * 100_000
    rows = [(0, long), (1, "a " + "字符" * 2000), (2, "word " * 400_000)] + [(3 + i, "x" + "語" * (100 + i)) for i in range(20)]
    texts = [t for _, t in rows]
    word, _ = library(WORD, texts)
    byte, _ = library(BYTE, texts)
    assert [bpe.tokenizer(WORD).encode(t).tolist() for t in texts] == word
    assert token_counts.counter(BYTE).counts(texts) == [len(i) for i in byte]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.unit_encoder(BYTE).encode(texts)] == byte
    assert all(len(u) <= bpe.LONG_UNIT + 1 for cache in (bpe.tokenizer(WORD).cache, token_counts.counter(BYTE).units, packing.unit_encoder(BYTE).units) for u in cache)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FA1F, exclude_categories=("Cs", "Cn")), max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    ids, _ = library(WORD, texts)
    assert [bpe.tokenizer(WORD).encode(t).tolist() for t in texts] == ids
    ids, _ = library(BYTE, texts)
    assert token_counts.counter(BYTE).counts(texts) == [len(i) for i in ids]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.unit_encoder(BYTE).encode(texts)] == ids


def best_fit(lengths, capacity):
    """One document at a time into the tightest bin that takes it."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(left)) if left[b] >= n]
        if fits:
            left[min(fits, key=lambda b: left[b])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    left, ranks = {}, {n: [] for n in histogram}
    for length, rank, per, first, offset in packing.plan(histogram, 30):
        following = [r for n, r, *_ in packing.plan(histogram, 30) if n == length and r > rank]
        stop = min(following, default=histogram[length])
        for r in range(rank, stop):
            b, slot = first + (r - rank) // per, (r - rank) % per
            assert left.setdefault(b, 30) == 30 - offset - slot * length
            left[b] -= length
            ranks[length].append(r)
    assert all(sorted(r) == list(range(histogram[n])) for n, r in ranks.items())
    assert sorted(left.values()) == best_fit(lengths, 30)


def test_packing_keeps_every_id(spark, docs):
    capacity = 64
    rows = packing.pack(docs, BYTE, capacity, 0, with_ids=True).collect()
    ids, _ = library(BYTE, [x for _, x, _ in ROWS])
    pieces = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 <= capacity
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["length"]))
    for (d, _, _), i in zip(ROWS, ids, strict=True):
        if d != 3:  # stands twice
            own = sorted(pieces[d])
            assert [x for _, _, part, _ in own for x in part] == [*i, 0]
            assert all(n == capacity for _, _, _, n in own[1:])
    assert len(pieces[3]) == 2
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_media_round_trip(docs):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    for d, text, _ in ROWS:
        data, r = (text or "").encode(), by_id[d]
        payload = bytes(r["payload"])
        assert payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
        assert len(payload) % media.FRAME == 0 and 0 < len(payload) < len(data) + media.FRAME + 1
        assert sum(c["frames"] for c in r["clips"]) == len(payload) // media.FRAME


def test_slow_decoder_agrees():
    frames = media.encode_frames(random.Random(3).randbytes(3 * media.FRAME))
    head = media._head(frames[0])
    fast = media.FrameFormat(head)
    scans = [f[len(head) : -2] for f in frames]
    for scan, want in zip(scans, fast.read(scans), strict=True):
        pixels = fast.slow(scan)
        assert (pixels == want.reshape(media.SIDE, media.SIDE).repeat(8, 0).repeat(8, 1)).all()


def jpeg(planes, quant, restart=0):
    """A baseline frame without Huffman tables, and its first plane as a plain sum of cosines gives it back.

    planes: one of (h, w), or luma twice as wide and high as two others.
    """
    size = [2, 1, 1] if len(planes) == 3 else [1]
    zigzag = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    code = [[{v: (n, c) for (n, c), v in t.items()} for t in ts] for ts in (media.STANDARD_DC, media.STANDARD_AC)]
    norm = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    wave = lambda x, u: math.cos((2 * x + 1) * u * math.pi / 16)
    back = np.zeros(planes[0].shape)
    bits, scan, last = "", b"", [0] * len(planes)

    def flush():
        nonlocal bits, scan
        bits += "1" * (-len(bits) % 8)
        scan += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    def value(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(k, y, x):
        nonlocal bits
        part = planes[k][8 * y : 8 * y + 8, 8 * x : 8 * x + 8].astype(float) - 128
        terms = [round(norm(u) * norm(v) / 4 * sum(part[i, j] * wave(i, u) * wave(j, v) for i in range(8) for j in range(8)) / quant[z]) for z, (u, v) in enumerate(zigzag)]
        if k == 0:
            for i in range(8):
                for j in range(8):
                    back[8 * y + i, 8 * x + j] = 128 + sum(norm(u) * norm(v) / 4 * t * q * wave(i, u) * wave(j, v) for t, q, (u, v) in zip(terms, quant, zigzag, strict=True))
        n, extra = value(terms[0] - last[k])
        last[k] = terms[0]
        put = lambda t, s: format(code[t][k > 0][s][1], f"0{code[t][k > 0][s][0]}b")
        bits += put(0, n) + extra
        run = 0
        for t in terms[1:]:
            if t == 0:
                run += 1
                continue
            while run > 15:
                bits, run = bits + put(1, 0xF0), run - 16
            n, extra = value(t)
            bits, run = bits + put(1, run << 4 | n) + extra, 0
        if run:
            bits += put(1, 0)

    units = [(y, x) for y in range(planes[0].shape[0] // (8 * size[0])) for x in range(planes[0].shape[1] // (8 * size[0]))]
    for n, (y, x) in enumerate(units):
        if restart and n and n % restart == 0:
            flush()
            scan += bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            last = [0] * len(planes)
        for k, s in enumerate(size):
            for i in range(s * s):
                block(k, y * s + i // s, x * s + i % s)
    flush()
    part = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    h, w = planes[0].shape
    frame = b"\xff\xd8" + part(0xDB, b"\0" + bytes(quant)) + (part(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    frame += part(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(size)]) + b"".join(bytes([k + 1, s << 4 | s, 0]) for k, s in enumerate(size)))
    frame += part(0xDA, bytes([len(size)]) + b"".join(bytes([k + 1, 0x11 * (k > 0)]) for k in range(len(size))) + bytes([0, 63, 0]))
    return frame + scan + b"\xff\xd9", np.clip(np.rint(back), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("colour", "restart"), [(False, 0), (True, 0), (True, 1)])
def test_foreign_frames_against_a_plain_decoder(spark, colour, restart):
    rng = np.random.default_rng(8)
    quant = [3 + k // 2 for k in range(64)]
    smooth = lambda h, w: np.clip(128 + 90 * np.sin(np.add.outer(np.arange(h) / 5, np.arange(w) / 7)) + rng.normal(0, 9, (h, w)), 0, 255).astype(np.uint8)
    planes = [smooth(32, 48), smooth(16, 24), smooth(16, 24)] if colour else [smooth(24, 40)]
    frame, want = jpeg(planes, quant, restart)
    (got,) = media.decode_frames([frame])
    assert np.abs(got[0].astype(int) - want.reshape(-1)).max() <= 1
    assert np.abs(got[0].astype(int) - planes[0].reshape(-1)).mean() < 8
    dark, _ = jpeg([np.full((16, 16), 9, np.uint8)], quant)
    own = media.encode_frames(bytes([200]) * media.FRAME)
    mixed = media.write_avi([frame] * 9 + [b""] + [dark] * 9 + own * 9)
    frames = [r for r in media.clip_rows(spark.createDataFrame([(1, mixed)], "doc_id long, media binary")).collect()]
    assert [(r["first_frame"], r["frames"]) for r in frames] == [(0, 10), (10, 9), (19, 9)]


def test_broken_media_never_stops_the_job(spark):
    rng = random.Random(12)
    whole = media.store(b"some text " * 300)
    none = media.write_avi([b"x"])[: -16 - 8 - 2 - 8]  # no index, no frame
    rows = [(0, none[: none.index(b"movi") - 4] + (4).to_bytes(4, "little") + b"movi")]
    for i in range(1, 120):
        data = bytearray(whole)
        for _ in range(rng.choice([1, 5, 60])):
            data[rng.randrange(len(data) if i % 2 else 700)] = rng.randrange(256)
        rows.append((i, bytes(data[: rng.choice([len(data), rng.randrange(len(data))])])))
    got = {r["doc_id"] for r in media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert 0 not in got and len(got) > 20


def test_index_is_optional_and_bad_media_is_null(spark):
    avi = media.store(b"x" * 2000)
    _, with_index = media.read_avi(avi)
    _, walked = media.read_avi(avi[: avi.rindex(b"idx1")])
    assert with_index == walked
    df = spark.createDataFrame([(1, avi), (2, b"no media"), (3, None), (4, avi[:100])], "doc_id long, media binary")
    got = {}
    for r in media.clip_rows(df).collect():
        got.setdefault(r["doc_id"], []).append(r["clip"])
    assert got[1] == list(range(len(got[1]))) and got[2] == [None] and 3 not in got and got[4] == [None]


def test_a_cut_is_found():
    calm = [np.full(media.FRAME, 10, np.uint8)] * 12 + [np.full(media.FRAME, 200, np.uint8)] * 12
    starts, _ = media.shots(media.histograms(np.stack(calm)))
    assert starts == [0, 12]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(none, WORD).count() == token_counts.count_tokens(none, BYTE).count() == media.media_columns(none).count() == 0
    assert packing.pack(none, BYTE).count() == 0
    assert media.clip_rows(none.select("doc_id", F.lit(None).cast("binary").alias("media"))).count() == 0


def plain_shots(samples):
    """Shots by loops over frames and greys."""
    shares = []
    for frame in samples:
        counts = [0] * media.BINS
        for grey in frame.tolist():
            counts[grey * media.BINS // 256] += 1
        shares.append([c / len(frame) for c in counts])
    change = [0.0] + [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2 for x, y in zip(shares, shares[1:], strict=False)]
    cuts = [0]
    for t in range(1, len(change)):
        around = [change[i] for i in range(max(t - media.AROUND, 1), min(t + media.AROUND + 1, len(change))) if i != t]
        mean = sum(around) / max(len(around), 1)
        spread = math.sqrt(max(sum(c * c for c in around) / max(len(around), 1) - mean * mean, 0.0))
        if change[t] >= media.LEAST and change[t] >= change[t - 1] and change[t] > (change[t + 1] if t + 1 < len(change) else 0) and change[t] > mean + media.DEVIATIONS * spread:
            cuts.append(t)
    return cuts, change


def test_feature_against_plain_histograms(spark):
    """The clips of texts of many styles, some of megabytes, are those of plain loops over the stored bytes."""
    rng = random.Random(9)
    style = lambda n, kinds: "".join(rng.choice(kinds) for _ in range(n))
    texts = [style(900, "abc ") + style(2000, "ABC0") + style(1500, "xyz\n"), style(40_000, "etaoin "), "", None, style(5, "a"), "".join(style(576 * 3, k) for k in ("ab", "ZZ9", "é", "  ", "~}", "ab") * 4), style(1_500_000, "lorem ipsum")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = media.media_columns(docs)
    rows = {}
    for r in media.clip_rows(columns.select("doc_id", "media")).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for r in columns.collect():
        payload = np.frombuffer(bytes(r["payload"]), np.uint8).reshape(-1, media.FRAME)
        cuts, change = plain_shots(payload)
        assert [c["first_frame"] for c in r["clips"]] == cuts and sum(c["frames"] for c in r["clips"]) == len(payload)
        mine = sorted(rows[r["doc_id"]], key=lambda x: x["clip"])
        assert [(x["clip"], x["first_frame"], x["start_s"]) for x in mine] == [(k, t, t / media.FPS) for k, t in enumerate(cuts)]
        assert [x["change"] for x in mine] == pytest.approx([change[t] for t in cuts], abs=1e-6)
