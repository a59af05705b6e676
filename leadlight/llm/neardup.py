"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, plain min-hashes, banded, verified.

A text is a weighted set of hashes of five consecutive words. The weight is the number of times a shingle stands in the
text times its inverse document frequency. Document frequencies of all texts come from two rows of hashed counters; what
other shingles put into a counter on average is taken off and the smaller of the two counts, so a rare shingle weighs the
same however many or long the texts are, and passages that many documents share weigh little.

Each of BANDS x ROWS samples picks a shingle and a step of its weight with a probability in proportion to that weight;
two texts agree in a sample with a probability equal to their weighted Jaccard similarity. For sampling alone weights are
rounded to quarter octaves; similarities are verified with exact weights. Texts that agree in all samples of a band are
candidates. A group's own size makes the shingles that it shares common and so light; for a pair that is alike on plain
shingles not to be lost by that, as many bands of unweighted min-hashes give candidates, too, and a pair is linked by its
weighted or by its plain Jaccard similarity. A pair at exactly 0.8 shares a band of its kind with probability 0.9998, and
agrees in enough samples to be looked at with probability 0.9999.

Equal texts are one node from the start. Nodes of a band are not paired all with all: first each meets the band's most
central node. Then, in bands that still hold several classes, the signatures of all nodes outside the band's largest class
are compared with all others there, in blocks; nodes with a partner that may be linked meet by their shingles, in blocks,
too, and only links that join two classes leave a block. So no link between two classes is lost, and what a group makes grows
with its size, not with the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.llm.common import as_bytes, bounded, discard, materialize, release
from leadlight.llm.words import mix, word_hashes

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
SAMPLES = BANDS * ROWS
#: Bytes of a node's marks: one of every sample and four of every band, weighted and plain.
MARKS = 2 * (SAMPLES + 4 * BANDS)
#: Counters of a row of the document-frequency table, as a power of two, and the share added to a frequency.
DF_BITS, SMOOTH = 17, 0.0065
DF_SIZE = 1 << DF_BITS
#: Counters that travel as one row.
DF_BLOCK = 4096
#: The weight of one rare shingle; sampling levels are quarter octaves from 2^LOWEST of it on.
RARE, LOWEST, LEVELS = float(np.log1p(1 / SMOOTH)), -3, 64
#: Random draws kept; a sample of a shingle takes one of them by a hash.
DRAWS = 1 << 16
#: Nodes of a band that others are compared with at a time, by signature and by shingles.
BLOCK, TEXT_BLOCK = 2048, 256
#: Bytes of text that one step holds.
STEP = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _keys() -> np.ndarray:
    """ln(a) of consistent weighted sampling for every level and draw, as 32 bits in the same order.

    The three random numbers of a draw are r and c, Gamma(2, 1), and b, uniform. With a draw, ln(a) tells the step, too.
    """
    r, c, b = _rng.gamma(2, 1, DRAWS), _rng.gamma(2, 1, DRAWS), _rng.random(DRAWS)
    out = np.empty(LEVELS * DRAWS, np.uint32)
    for level in range(LEVELS):
        step = np.floor((np.log(RARE) + (LOWEST + level / 4) * np.log(2)) / r + b)
        bits = (np.log(c) - r * (step - b) - r).astype(np.float32).view(np.uint32)
        out[level * DRAWS : (level + 1) * DRAWS] = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    return out


_LOG_A = _keys()


# ---- texts to shingles ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Sets:
    """Distinct shingle hashes of texts, ascending in each, how often each stands, where each text's begin, and its words."""

    hashes: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray
    words: list[np.ndarray]

    def node(self, i: int) -> bytes:
        """What tells the words of text ``i`` from other texts'."""
        return xxhash.xxh3_128_digest(self.words[i].tobytes())


def shingled(texts: list[bytes]) -> Sets:
    """The shingles of texts; fewer than SHINGLE words are one shingle."""
    starts, h = word_hashes(b" ".join(texts) + b" ") if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    begin, end = bounds[:-1], bounds[1:]
    n, length = len(h), end - begin
    total, single = np.zeros(n, np.uint64), np.zeros(len(texts), np.uint64)
    for j in range(min(SHINGLE, n)):
        total[: n - j] = total[: n - j] * GOLDEN + mix(h[j:] + np.uint64(j))
        short = length == j + 1
        single[short] = total[begin[short]]
    valid = np.ones(n, bool)
    for j in range(1, SHINGLE):
        valid[end[length >= j] - j] = False
    short = (length > 0) & (length < SHINGLE)
    total[begin[short]], valid[begin[short]] = single[short], True
    found = mix(total[valid])
    offsets = np.concatenate([[0], np.cumsum(np.maximum(length - SHINGLE + 1, length > 0))])
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found[s:e].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[offsets[offsets < len(found)]] = True
    at = np.flatnonzero(new)
    return Sets(found[at], np.diff(at, append=len(found)), np.searchsorted(at, offsets), [h[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)])


# ---- weights, signatures, similarities ------------------------------------------------------------


def df_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's counter in either row of the document-frequency table."""
    mask = np.uint64(DF_SIZE - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(DF_BITS)) & mask).astype(np.int64)


def weights(sets: Sets, shares: np.ndarray) -> np.ndarray:
    """Count times inverse document frequency of every shingle; shares: the table of ``document_shares``."""
    first, second = df_places(sets.hashes)
    return sets.counts * np.log1p(1 / (SMOOTH + np.minimum(shares[0][first], shares[1][second]).astype(np.float64)))


def signatures(sets: Sets, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x SAMPLES) weighted samples, and plain ones (the least product of a shingle with each factor).

    Only texts with words have a row. A weighted sample holds its ln(a) and half of the product of its shingle.
    """
    level = np.clip(np.rint(4 * (np.log2(weight / RARE) - LOWEST)), 0, LEVELS - 1).astype(np.int64) * DRAWS
    begin = sets.offsets[:-1][np.diff(sets.offsets) > 0]
    weighted, plain = np.empty((len(begin), SAMPLES), np.uint64), np.empty((len(begin), SAMPLES), np.uint64)
    if len(begin):
        for k, factor in enumerate(_FACTORS):
            product = sets.hashes * factor
            plain[:, k] = np.minimum.reduceat(product, begin)
            key = _LOG_A[(product >> np.uint64(48)).view(np.int64) + level].astype(np.uint64)
            weighted[:, k] = np.minimum.reduceat(key << np.uint64(32) | product >> np.uint64(32), begin)
    return weighted, plain


def bands(samples: np.ndarray, first: int = 1) -> np.ndarray:
    """(texts x BANDS) signed 64-bit hashes; bands are numbered from ``first`` on."""
    total = np.broadcast_to(np.arange(first, first + BANDS, dtype=np.uint64), (len(samples), BANDS))
    for row in np.moveaxis(samples.reshape(-1, BANDS, ROWS), 2, 0):
        total = mix(total * GOLDEN + row)
    return total.view(np.int64)


def marks(samples: np.ndarray) -> np.ndarray:
    """A byte of each sample; equal samples have equal bytes."""
    return (mix(samples) & np.uint64(255)).astype(np.uint8)


def similarities(hub: tuple[np.ndarray, np.ndarray], sets: Sets, weight: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Weighted or plain Jaccard similarity, whichever is more, of ``hub`` (hashes, weights) with texts lo to hi, all with words."""
    part, begin = slice(sets.offsets[lo], sets.offsets[hi]), sets.offsets[lo:hi] - sets.offsets[lo]
    own, w = sets.hashes[part], weight[part]
    at = np.minimum(np.searchsorted(hub[0], own), len(hub[0]) - 1)
    hit = hub[0][at] == own
    low = np.add.reduceat(np.where(hit, np.minimum(hub[1][at], w), 0.0), begin)
    common = np.add.reduceat(hit.astype(np.int64), begin)
    sizes = np.diff(sets.offsets[lo : hi + 1])
    return np.maximum(low / (hub[1].sum() + np.add.reduceat(w, begin) - low), common / (len(hub[0]) + sizes - common))


def similarity(a: bytes, b: bytes, shares: np.ndarray) -> float:
    """The similarity of two texts with words."""
    sets = shingled([a, b])
    weight = weights(sets, shares)
    cut = sets.offsets[1]
    return float(similarities((sets.hashes[:cut], weight[:cut]), sets, weight, 1, 2)[0])


# ---- Spark: texts ---------------------------------------------------------------------------------


def wordless(texts: DataFrame) -> DataFrame:
    """The texts that have no words."""
    return texts.where(~F.col("data").cast("string").rlike(r"[^\x09-\x0D\x20]"))


def digest(data: object) -> Column:
    """What tells texts apart byte by byte."""
    return F.unhex(F.md5(data))


def document_shares(texts: DataFrame) -> np.ndarray:
    """(2 x DF_SIZE) float32: of each counter, the share of all texts that a shingle there stands in, without the average of others.

    Tasks send blocks of their counters; 2 * DF_SIZE sums come to the driver.
    """
    blocks = 2 * DF_SIZE // DF_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, DF_SIZE), np.int64), 0
        for batch in bounded(batches, "data", STEP):
            sets = shingled(batch.column(0).to_pylist())
            n += int((np.diff(sets.offsets) > 0).sum())
            for row, at in zip(total, df_places(sets.hashes), strict=True):
                row += np.bincount(at, minlength=DF_SIZE)
        if n:
            parts = [np.array([n]).tobytes(), *(x.tobytes() for x in total.reshape(blocks, DF_BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, blocks), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    sums = {r["block"]: np.frombuffer(r["counts"], np.int64) for r in texts.mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).collect()}
    if not sums:
        return np.zeros((2, DF_SIZE), np.float32)
    table = np.concatenate([sums[i] for i in range(blocks)]).reshape(2, DF_SIZE)
    others = (table.sum(1, keepdims=True) - table) / (DF_SIZE - 1)
    return (np.maximum(table - others, 0) / sums[-1][0]).astype(np.float32)


def sketched(texts: DataFrame, shares: np.ndarray) -> DataFrame:
    """(id, digest binary, node binary, weight double, size long, bands array<long>, marks binary) of every text with words.

    node is a hash of its words, digest one of its bytes, size the number of its distinct shingles; marks are a byte of
    every sample and four of every band.
    """
    kind = texts.schema["id"].dataType.simpleString()
    texts = texts.select("id", "data", digest("data").alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "data", STEP):
            sets = shingled(batch.column(1).to_pylist())
            weight = weights(sets, shares)
            full = np.flatnonzero(np.diff(sets.offsets))
            both = signatures(sets, weight)
            begin = sets.offsets[full]
            keys = np.concatenate([bands(both[0]), bands(both[1], 1 + BANDS)], 1)
            columns = [
                *(batch.column(i).take(pa.array(full)) for i in (0, 2)),
                pa.array([sets.node(i) for i in full.tolist()], pa.binary()),
                pa.array(np.add.reduceat(weight, begin) if len(begin) else np.zeros(0)),
                pa.array(np.diff(sets.offsets)[full]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * (2 * BANDS)), pa.array(keys.ravel())),
                pa.array([x.tobytes() for x in np.concatenate([marks(both[0]), marks(both[1]), keys.astype(np.uint32).view(np.uint8)], 1)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "node", "weight", "size", "bands", "marks"])
        release()

    return texts.mapInArrow(run, f"id {kind}, digest binary, node binary, weight double, size long, bands array<long>, marks binary")


def packed(texts: DataFrame) -> DataFrame:
    """(id, data) with every text compressed, to be sent."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in bounded(batches, "data"):
            yield batch.set_column(1, "data", pa.array([press(x) for x in batch.column(1).to_pylist()], pa.binary()))
        release()

    return texts.select("id", "data").mapInArrow(run, f"id {kind}, data binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def keyed(texts: DataFrame, is_packed: bool) -> DataFrame:
    """(node, packed data) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in bounded(batches, "data", STEP // 2 if is_packed else STEP):
            data = batch.column(0)
            sets = shingled(_unpacked(data) if is_packed else data.to_pylist())
            data = data if is_packed else pa.array([press(x) for x in data.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([sets.node(i) for i in range(batch.num_rows)], pa.binary()), data], ["node", "data"])
        release()

    return texts.select("data").mapInArrow(run, "node binary, data binary")


# ---- Spark: pairs ---------------------------------------------------------------------------------


def enough(least: float) -> int:
    """The samples that a pair of that similarity shares at the least, but once in 10,000 times."""
    return int(SAMPLES * least - 4 * np.sqrt(SAMPLES * least * (1 - least)))


def _likely(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], least: float) -> np.ndarray:
    """Where nodes (marks, weight, size) may be similar by samples and totals; arrays of one shape but for the marks' last axis."""
    same, out = a[0][..., : 2 * SAMPLES] == b[0][..., : 2 * SAMPLES], False
    for i, part in ((1, slice(SAMPLES)), (2, slice(SAMPLES, None))):
        near = np.minimum(a[i], b[i]) >= (least - 1e-9) * np.maximum(a[i], b[i])
        out |= near & (np.count_nonzero(same[..., part], -1) >= enough(least))
    return out


def _first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of the first band that nodes share, by their marks."""
    return (a[..., 2 * SAMPLES :].view(np.uint32) == b[..., 2 * SAMPLES :].view(np.uint32)).argmax(-1)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A column of byte strings of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def likely(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may be similar by samples and totals; for either there are a marks, weight and size column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ((_bytes(batch.column(i), MARKS), *(batch.column(j).to_numpy() for j in (i + 1, i + 2))) for i in (2, 5))
            yield batch.select(["a", "b"]).filter(pa.array(_likely(a, b, least)))

    return pairs.select("a", "b", "a_marks", "a_weight", "a_size", "marks", "weight", "size").mapInArrow(run, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, shares: np.ndarray, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted or plain Jaccard similarity is at least ``least``.

    texts: (node, data), packed. A hub's text comes once, first among the rows of its partners; a hub with very many partners is
    spread, and each part has its text.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TEXT_BLOCK).cast("int").alias("parts"))
    hubs = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"))
    partners = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("turn"))
    rows = hubs.unionByName(partners).join(texts.select(F.col("node").alias("b"), "data"), "b")
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "turn").select("a", "b", "turn", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in bounded(batches, "data", STEP // 2):
            sets = shingled(_unpacked(batch.column(3)))
            weight, turn = weights(sets, shares), batch.column(2).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            first = [*np.flatnonzero(turn == 0).tolist(), batch.num_rows]
            for lo, hi in zip([-1, *first[:-1]], first, strict=True):
                if lo >= 0:
                    part = slice(sets.offsets[lo], sets.offsets[lo + 1])
                    hub = sets.hashes[part].copy(), weight[part].copy()
                if lo + 1 < hi:
                    keep[lo + 1 : hi] = similarities(hub, sets, weight, lo + 1, hi) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        release()

    return dealt.mapInArrow(run, "a binary, b binary")


def _dealt(rows: DataFrame, block: int, *columns: str) -> DataFrame:
    """Rows (band, part, turn, columns) of open bands: in each part some nodes outside the main class (turn 0), then the others.

    rows: (band, root, main, outside: the band's number of rows outside its main class, columns). A part has about ``block``.
    """
    rows = rows.withColumn("parts", F.ceil(F.col("outside") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    outside, turn = F.col("root") != F.col("main"), F.lit(1).alias("turn")
    own = rows.where(outside).select("band", "part", F.lit(0).alias("turn"), *columns)
    once = rows.where(~outside & (F.col("parts") == 1)).select("band", F.lit(0).alias("part"), turn, *columns)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: ~outside | (p != F.col("part")))
    more = rows.where("parts > 1").select("band", F.explode(others).alias("part"), turn, *columns)
    return own.unionByName(once).unionByName(more).repartition("band", "part").sortWithinPartitions("band", "part", "turn")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int, int]]:
    """((band, part), turn, from, to) of rows that follow each other."""
    band, part, turn = (batch.column(i).to_numpy() for i in range(3))
    cut = [0, *(np.flatnonzero((np.diff(band) != 0) | (np.diff(part) != 0) | (np.diff(turn) != 0)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield (int(band[lo]), int(part[lo])), int(turn[lo]), lo, hi


def promising(rows: DataFrame, least: float) -> DataFrame:
    """The (band, node) of open bands that may be linked to a node of another class there, by samples and totals.

    Of several bands that a pair shares only the first counts. (Four bytes stand for a band: a pair is taken to share one
    that it doesn't share once in 100 million times.)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turned, names, held, told = None, False, [], [], np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, roots, numbers = batch.column(3).to_pylist(), _bytes(batch.column(4), 16).view(np.uint64), batch.column(8).to_numpy()
            own = (_bytes(batch.column(5), MARKS), batch.column(6).to_numpy(), batch.column(7).to_numpy(), roots)
            found: list[tuple[int, bytes]] = []
            for at, turn, lo, hi in _runs(batch):
                part = [x[lo:hi] for x in own]
                if turn == 0:
                    if key != at:
                        key, turned, names, held = at, False, [], [x[:0] for x in own]
                    names, held = names + nodes[lo:hi], [np.concatenate(x) for x in zip(held, part, strict=True)]
                    continue
                if key != at:  # a part that no node outside the main class fell into
                    continue
                met = [(part, nodes[lo:hi])] if turned else [(held, names), (part, nodes[lo:hi])]
                told, turned = told if turned else np.zeros(len(names), bool), True
                step = max(1, (1 << 22) // (len(names) * MARKS))
                for side, side_names in met:
                    for s in range(0, len(side_names), step):
                        tile = [x[s : s + step, None] for x in side]
                        able = _likely(tuple(tile[:3]), tuple(x[None] for x in held[:3]), least) & (tile[3] != held[3][None]).any(-1)
                        if able.any():
                            i, j = np.nonzero(able)
                            able[i, j] = _first_band(side[0][s + i], held[0][j]) == numbers[lo]
                        found += [(at[0], side_names[s + int(i)]) for i in np.flatnonzero(able.any(1))]
                        fresh = able.any(0) & ~told
                        found += [(at[0], names[int(i)]) for i in np.flatnonzero(fresh)]
                        told |= fresh
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["band", "node"])
        release()

    return _dealt(rows, BLOCK, "node", "root", "marks", "weight", "size", "number").mapInArrow(run, "band long, node binary").distinct()


class _Block:
    """Texts of one part of a band, by their shingles, and which of their classes links have joined so far."""

    def __init__(self, names: list[bytes], roots: list[bytes], sets: Sets, weight: np.ndarray) -> None:
        order = np.argsort(sets.hashes, kind="stable")
        self.names, self.roots, self.above = names, roots, {}
        self.sizes = np.diff(sets.offsets)
        owner = np.repeat(np.arange(len(names)), self.sizes)
        self.totals = np.bincount(owner, weight, len(names))
        self.hashes, self.owner, self.weight = sets.hashes[order], owner[order], weight[order]

    def top(self, x: bytes) -> bytes:
        while self.above.get(x, x) != x:
            x = self.above[x]
        return x

    def links(self, name: bytes, root: bytes, h: np.ndarray, w: np.ndarray, least: float) -> Iterator[tuple[bytes, bytes]]:
        """Links of a text (hashes, weights) to those of other classes here; one for classes that a link has joined."""
        first = np.searchsorted(self.hashes, h)
        times = np.searchsorted(self.hashes, h, "right") - first
        hit = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        low = np.bincount(self.owner[hit], np.minimum(self.weight[hit], np.repeat(w, times)), len(self.sizes))
        common = np.bincount(self.owner[hit], minlength=len(self.sizes))
        alike = np.maximum(low / (self.totals + w.sum() - low), common / (self.sizes + len(h) - common))
        for j in np.flatnonzero(alike >= least).tolist():
            x, y = self.top(self.roots[j]), self.top(root)
            if x != y:
                self.above[x] = y
                yield self.names[j], name


def joining(rows: DataFrame, shares: np.ndarray, least: float) -> DataFrame:
    """Verified links (a, b) between classes of a band; of links that join the same classes in a part one is enough.

    rows: those of ``promising`` with their packed texts (data).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, names, roots, texts = None, None, [], [], []
        for batch in bounded(batches, "data", STEP // 2):
            node, root, data = batch.column(3).to_pylist(), batch.column(4).to_pylist(), _unpacked(batch.column(5))
            found: list[tuple[bytes, bytes]] = []
            for at, turn, lo, hi in _runs(batch):
                if turn == 0:
                    if key != at:
                        key, block, names, roots, texts = at, None, [], [], []
                    names, roots, texts = names + node[lo:hi], roots + root[lo:hi], texts + data[lo:hi]
                    continue
                if key != at:
                    continue
                met = [(node[lo:hi], root[lo:hi], shingled(data[lo:hi]))]
                if block is None:
                    sets = shingled(texts)
                    block, texts = _Block(names, roots, sets, weights(sets, shares)), []
                    met.insert(0, (names, roots, sets))
                for side_names, side_roots, sets in met:
                    weight = weights(sets, shares)
                    for i, (name, own) in enumerate(zip(side_names, side_roots, strict=True)):
                        part = slice(sets.offsets[i], sets.offsets[i + 1])
                        found += block.links(name, own, sets.hashes[part], weight[part], least)
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary())], ["a", "b"])
        release()

    return _dealt(rows, TEXT_BLOCK, "node", "root", "data").mapInArrow(run, "a binary, b binary")


# ---- Spark: classes -------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of undirected edges (a, b), the root being the least node of its component.

    Alternates large and small stars until no node has edges both up and down; every turn is written to the shared folder,
    and the one before it deleted. Least neighbours are pre-aggregated and joined, so a node with very many edges is no hot
    window.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")

    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        # done if each node hangs on one least node that hangs on none: every u stands once and is no v
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        old = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = least(large)
        edges = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        discard(old)


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """With the root of each row's node; a node without links is its own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of bands that hold several classes, with root, main (the largest class's) and outside (how many are not in it)."""
    rooted = _rooted(rows, roots)
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    of = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    return rooted.join(of, "band")


def _found(texts: DataFrame, least: float) -> DataFrame:
    """(id, digest, node, root) of every text (id, data) that has words; texts with one root are a class."""
    shares = document_shares(texts.select("data"))
    sketches = materialize(sketched(texts, shares), "sketches")
    nodes = sketches.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("weight", "size", "bands", "marks")))

    # bands that at least two nodes share; half of a node's hash finds them, nodes that share it are told apart after
    in_bands = nodes.select(F.xxhash64("node").alias("short"), F.posexplode("bands").alias("number", "band")).withColumn("number", F.col("number").cast("byte"))
    shared = in_bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialize(in_bands.join(shared, "band"), "bands")
    central = crowded.groupBy("short").agg(F.sum("n").alias("central"))
    known = nodes.drop("bands").withColumn("short", F.xxhash64("node")).join(central, "short").drop("short")
    known = materialize(known, "nodes")
    # ids only say which texts to look at, as they may be null or clash; nodes say whose text it is
    # a merge join always: with a broadcast two Python stages would share a task, and each executor hold twice the workers
    wanted = known.select("id").distinct().hint("merge")
    looked_at = keyed(packed(texts.where("id is not null")).join(wanted, "id", "left_semi"), True).unionByName(keyed(texts.where("id is null"), False))
    shown = materialize(looked_at.join(known.select("node"), "node", "left_semi").dropDuplicates(["node"]), "texts")
    short = known.select("node", "central", F.xxhash64("node").alias("short"))
    rows = materialize(crowded.select("band", "number", "short").join(short, "short").drop("short"), "crowded")
    looks = known.select("node", "marks", "weight", "size")

    # each node with the most central one of its band: of a text and its many copies, that is the text
    hubs = rows.groupBy("band").agg(F.max_by("node", F.struct("central", "node")).alias("a"))
    met = rows.join(hubs, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    of_hubs = looks.select(F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in looks.columns[1:]])
    pairs = materialize(likely(met.join(of_hubs, "a").join(looks.withColumnRenamed("node", "b"), "b"), least), "pairs")
    roots = materialize(components(verified(pairs, shown, shares, least)), "roots")

    # what is left: all nodes of a band outside its largest class, with all nodes of other classes there
    left = materialize(_open(rows.select("band", "number", "node"), roots), "open")
    able = materialize(left.select("band", "node").join(promising(left.join(looks, "node"), least), ["band", "node"], "left_semi"), "promising")
    asked = _open(able, roots).join(shown, "node")
    links = joining(asked, shares, least)
    roots = materialize(components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    return _rooted(sketches.select("id", "digest", "node"), roots)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (id, class_id, class_size long) of every row: the class's smallest id and its number of rows.

    Two rows are in one class if a chain of links joins them: equal words, or a verified similarity, weighted or
    plain, of at least ``least``; bands are set for 0.8, below that more links are missed. Words are what stands between
    ASCII white space, A-Z lower case. A text that is null, empty or without words is alone; an empty table gives an
    empty result. Texts of any length are compared whole. Repeated rows are copies of each other; different texts with one
    id are rows of their own; rows without an id have a class, too, but are not its smallest id. Other columns are not read.
    """
    texts = docs.select(F.col(id_column).alias("id"), as_bytes(text_column).alias("data"))
    found = materialize(_found(texts, least).select("id", "root"), "found")
    classes = materialize(found.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    with_words = found.join(classes, "root").select("id", "class_id", "class_size")
    alone = wordless(texts).select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return with_words.unionByName(alone).withColumnRenamed("id", id_column)


def one_of_each(docs: DataFrame, least: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each class: the one with the smallest id stays.

    Of several texts of a class with that id the one with the smallest MD5 stays, of repeated rows one. Rows without an id
    come last, so such a row stays where its whole class has none. Different texts may share an id; each is kept or dropped
    with its own class. Texts without words are no copies of each other: all of their rows stay. All columns stay.
    """
    texts = docs.select(F.col(id_column).alias("id"), as_bytes(text_column).alias("data"))
    found = _found(texts, least)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "digest")).alias("x"))
    kept = chosen.select(F.col("x.id").alias("__id"), F.col("x.digest").alias("__digest"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = (names[docs.columns.index(c)] for c in (id_column, text_column))
    marked = docs.toDF(*names).withColumn("__data", as_bytes(text_at)).withColumn("__key", digest("__data"))
    empty = ~F.col("__data").cast("string").rlike(r"[^\x09-\x0D\x20]")
    with_words = marked.where(~empty).join(kept, F.col(id_at).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__digest")))
    first = with_words.withColumn("__n", F.row_number().over(W.partitionBy(id_at, "__key").orderBy(F.lit(0)))).where("__n = 1")
    return first.select(names).unionByName(marked.where(empty).select(names)).toDF(*docs.columns)
