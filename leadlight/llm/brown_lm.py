"""Language-model scores by Brown's class-based bigrams.

Every word has one class; P(text) is the product of class transitions and word emissions, smoothed, from the start of a
text to its end token. Classes come from exchange clustering: an item moves to the class that raises the likelihood of the
class bigrams most. The HEADS most frequent words are exchanged one by one on the driver until none moves or for PASSES
passes. Then every other word that stands LEAST times or more in training is exchanged, all of them at once, by its own
counts beside each class, which Spark sums over all texts: that vocabulary grows with the input. Rarer and unknown words
have one class for each shape (letters, digits, beyond ASCII, other signs).

Counts of words know no bound, so they never come to the driver or to every task. Texts are packed into chunks of numbered
words. A chunk sends its distinct words, by ranges of their hashes, with counts, and later with counts beside classes; each
range sums over all chunks and answers every chunk with the sums, and later the classes, of its words in their order. So a
common word costs one entry for each chunk of CHUNK bytes, not a row, and ranges are alike in size. There are RANGES ranges
for each of the session's shuffle partitions; a task holds one range at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.common import as_bytes, bounded, discard, materialize, release
from leadlight.llm.words import SHAPES, word_hashes, word_shapes

HEADS, CLASSES, PASSES = 512, 48, 12
#: Words that stand as often are items of the distributed exchange.
LEAST = 10
#: Bytes of text of a chunk; a longer single text makes a chunk of its own.
CHUNK = 20 << 20
#: Ranges of word hashes for each shuffle partition, at least.
RANGES = 2
#: Weight of the class frequencies in a transition's probability.
PRIOR = 20.0
#: Class 0 is the end of a text, 1 to SHAPES are rare words, then come those of the exchange.
FIRST = 1 + SHAPES


# ---- exchange clustering --------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def _gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, same: float) -> np.ndarray:
    """What an item adds to the likelihood in each class, by its neighbours' classes; ``table`` is without the item."""
    rows, columns = table.sum(1) + left, table.sum(0) + right  # its neighbours keep it beside them in any class
    old = _xlogx(table)
    gain = (_xlogx(table + right) - old).sum(1) + (_xlogx(table + left[:, None]) - old).sum(0)
    d = np.diag(table)
    gain += _xlogx(d + right + left + same) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    gain -= _xlogx(rows + right.sum() + same) - _xlogx(rows) + _xlogx(columns + left.sum() + same) - _xlogx(columns)
    gain[:FIRST] = -np.inf
    return gain


def best_class(table: np.ndarray, c: int, right: np.ndarray, left: np.ndarray, same: float) -> int:
    """The best class of an item of class ``c``; ``table`` and the counts beside each class are with the item itself."""
    right, left, table = right.astype(np.float64), left.astype(np.float64), table.copy()
    right[c] -= same
    left[c] -= same
    table[c] -= right
    table[:, c] -= left
    table[c, c] -= same
    gain = _gains(table, right, left, same)
    best = int(np.argmax(gain))
    return c if gain[best] <= gain[c] + 1e-9 else best


def transitions_of(table: np.ndarray) -> np.ndarray:
    """log10 transition probabilities, smoothed by the class frequencies."""
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * len(table))
    return np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))


def exchange(pairs: np.ndarray, fixed: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each item from its bigram counts (item x item).

    The first items have the classes ``fixed``, below FIRST; the others go to ``classes`` classes from FIRST on, start round
    robin by frequency and are exchanged one by one. Ties go to the lower class.
    """
    n, k = len(pairs), len(fixed)
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(0) + pairs.sum(1)
    order = k + np.argsort(-weight[k:], kind="stable")
    of = np.concatenate([fixed, np.zeros(n - k, np.int64)]).astype(np.int64)
    of[order] = FIRST + np.arange(n - k) % classes
    member = np.zeros((n, FIRST + classes))
    member[np.arange(n), of] = 1
    table = member.T @ pairs @ member
    for _ in range(passes):
        moved = False
        for w in order:
            if not weight[w]:
                continue
            c = of[w]
            member[w, c] = 0
            right, left, same = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            table[c] -= right
            table[:, c] -= left
            table[c, c] -= same
            gain = _gains(table, right, left, same)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            moved |= best != c
            of[w] = best
            member[w, best] = 1
            table[best] += right
            table[:, best] += left
            table[best, best] += same
        if not moved:
            break
    return of


def class_table(pairs: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Class bigram counts of items' bigram counts."""
    member = np.zeros((len(of), classes))
    member[np.arange(len(of)), of] = 1
    return member.T @ pairs @ member


def emissions(counts: np.ndarray, classes: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> np.ndarray:
    """log10 probability of a word of that count in its class; half a count each, and for one unseen word."""
    return np.log10((counts + 0.5) / (tokens[classes] + 0.5 * (types[classes] + 1)))


# ---- chunks ---------------------------------------------------------------------------------------

_chunk = "chunk long, docs binary, lengths binary, hashes binary, order binary, counts binary, shapes binary, low binary, mid binary, high binary"


def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _read(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Chunk:
    """Texts as numbers of distinct words, the most frequent first.

    docs: Arrow table (id, held). lengths: words of each text. hashes: of the distinct words, ascending; order: their
    numbers; counts (in training texts) and shapes of the words in the order of hashes. words: the numbers of all texts' words.
    """

    def __init__(self, row: dict) -> None:
        self.docs = pa.ipc.open_stream(row["docs"]).read_all()
        self.number, self.lengths, self.order = row["chunk"], _read(row["lengths"], np.int64), _read(row["order"], np.int32)
        self.hashes = _read(row["hashes"], np.uint64) if row.get("hashes") else None
        self.counts, self.shapes = _read(row["counts"], np.int64), _read(row["shapes"], np.uint8)
        low, mid, high = (_read(row[c], k) for c, k in (("low", np.uint8), ("mid", np.uint8), ("high", np.uint16)))
        self.words = high.astype(np.int32) << 16 | mid.astype(np.int32) << 8 | low

    def training(self) -> np.ndarray:
        """The numbers of all training texts' words, each text between ends; the end's number is that of distinct words."""
        held = self.docs.column("held").to_numpy()
        words, lengths = self.words[np.repeat(~held, self.lengths)], self.lengths[~held]
        return np.insert(words, np.concatenate([[0], np.cumsum(lengths)]), len(self.order)) if len(lengths) else np.zeros(0, np.int32)

    def numbered(self, of_hashes: np.ndarray, of_end: float) -> np.ndarray:
        """Values by number, from those of the words in the order of hashes and the end's."""
        out = np.empty(len(self.order) + 1, of_hashes.dtype)
        out[self.order], out[-1] = of_hashes, of_end
        return out

    def ranges(self, bits: int, only: np.ndarray | None = None) -> Iterator[tuple[int, slice]]:
        """Each range of hashes (their leading bits) that has words, and where those stand among ``only`` (or all) of them."""
        hashes = self.hashes if only is None else self.hashes[only]
        cut = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
        for r in np.flatnonzero(np.diff(cut)).tolist():
            yield r, slice(cut[r], cut[r + 1])


def _packed(number: int, ids: list, held: list, texts: list, id_type: pa.DataType) -> dict:
    """A chunk's row."""
    blob = b" ".join(texts) + b" "
    starts, hashes = word_hashes(blob)
    lengths = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))
    own, first, at, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    order = np.empty(len(own), np.int32)
    order[np.argsort(-times, kind="stable")] = np.arange(len(own), dtype=np.int32)
    words = order[at]
    counts = np.bincount(at[np.repeat(~np.array(held, bool), lengths)], minlength=len(own))
    sink = pa.BufferOutputStream()
    docs = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(held, pa.bool_())], ["id", "held"])
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(docs)
    parts = {"lengths": lengths, "hashes": own, "order": order, "counts": counts, "shapes": word_shapes(blob, starts)[first], "low": (words & 255).astype(np.uint8), "mid": (words >> 8 & 255).astype(np.uint8), "high": (words >> 16).astype(np.uint16)}
    return {"chunk": number, "docs": sink.getvalue().to_pybytes()} | {k: _press(v) for k, v in parts.items()}


def chunked(docs: DataFrame, held_out: object, id_column: str, text_column: str) -> DataFrame:
    """Rows of chunks."""
    schema = pa.schema([("chunk", pa.int64()), *((x.split()[0], pa.binary()) for x in _chunk.split(", ")[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size, ids, held, texts
            row = _packed(number, ids, held, texts, id_type)
            number, ids, held, texts, size = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in bounded(batches, "data"):
            id_type = batch.column(0).type
            if size and size + batch.column(2).nbytes > CHUNK:
                yield flush()
            ids += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            texts += batch.column(2).to_pylist()
            size += batch.column(2).nbytes
        if ids:
            yield flush()
        release()

    rows = docs.select(F.col(id_column).alias("id"), held_out.alias("held"), as_bytes(text_column).alias("data"))
    return rows.mapInArrow(run, _chunk)


def _each(chunks: DataFrame, make: object, kind: str) -> DataFrame:
    """What ``make`` yields for every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from make(Chunk(batch.slice(i, 1).to_pylist()[0]))
        release()

    return chunks.mapInArrow(run, kind)


def _by_range(parts: DataFrame, make: object, kind: str) -> DataFrame:
    """What ``make`` yields for the rows (as dicts) of every value of ``range``; a task holds those of one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["range"] != row["range"]:
                    yield from make(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from make(rows)
        release()

    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(run, kind)


def _summed(rows: DataFrame, key: str, value: str, size: int) -> np.ndarray:
    """Sums of (key, value) rows as an array of ``size``, which bounds what comes to the driver."""
    found = rows.groupBy(key).agg(F.sum(value).alias(value)).toArrow()
    total = np.zeros(size, np.int64)
    total[found.column(key).to_numpy()] = found.column(value).to_numpy()
    return total


def _counted(pairs: np.ndarray, size: int) -> pa.RecordBatch:
    total = np.bincount(pairs, minlength=size)
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


# ---- counts of words ------------------------------------------------------------------------------

#: Rows of answers to chunks, and rows of sums (chunk null): of what, in which class, how many words and tokens.
_answers = "chunk long, range int, answer binary, kind string, class int, types long, tokens long, word binary"
_answer_schema = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("answer", pa.binary()), ("kind", pa.string()), ("class", pa.int32()), ("types", pa.int64()), ("tokens", pa.int64()), ("word", pa.binary())])


def _answered(rows: list[dict], at: np.ndarray, values: np.ndarray, sums: list[dict]) -> pa.RecordBatch:
    """To each chunk's row of a range the values of its words (``at`` says which), and rows of sums."""
    cut = np.cumsum([0, *(r["size"] for r in rows)])
    answers = [{"chunk": r["chunk"], "range": r["range"], "answer": _press(values[at[lo:hi]])} for r, lo, hi in zip(rows, cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_pylist(answers + sums, _answer_schema)


def _word_counts(chunks: DataFrame, bits: int) -> DataFrame:
    """Training counts over all chunks of every chunk's words (int64, by range); sums: seen words by shape, most frequent words."""

    def send(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        rows = [{"chunk": chunk.number, "range": r, "size": s.stop - s.start, "hashes": _press(chunk.hashes[s]), "counts": _press(chunk.counts[s]), "shapes": _press(chunk.shapes[s])} for r, s in chunk.ranges(bits)]
        if rows:
            yield pa.RecordBatch.from_pylist([{k: int(v) if k == "size" else v for k, v in r.items()} for r in rows], pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("size", pa.int64()), *((c, pa.binary()) for c in ("hashes", "counts", "shapes"))]))

    def add(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own, first, at = np.unique(np.concatenate([_read(r["hashes"], np.uint64) for r in rows]), return_index=True, return_inverse=True)
        total = np.bincount(at, np.concatenate([_read(r["counts"], np.int64) for r in rows])).astype(np.int64)
        shapes = np.concatenate([_read(r["shapes"], np.uint8) for r in rows])[first]
        seen = total > 0
        # counts of counts below LEAST tell the rare words; the rest is known by class later
        sums = [{"kind": "shape", "class": 1 + k, "types": int((seen & (shapes == k)).sum()), "tokens": int(total[shapes == k].sum())} for k in range(SHAPES)]
        sums += [{"kind": "rare", "class": 1 + k, "types": int((low := seen & (shapes == k) & (total < LEAST)).sum()), "tokens": int(total[low].sum())} for k in range(SHAPES)]
        sums.append({"kind": "top", "range": rows[0]["range"], "word": _top(own, total, shapes).tobytes()})
        yield _answered(rows, at, total, sums)

    return _by_range(_each(chunks, send, "chunk long, range int, size long, hashes binary, counts binary, shapes binary"), add, _answers)


#: A frequent word, its count and shape.
TOP = np.dtype([("word", "<u8"), ("count", "<i8"), ("shape", "u1")])


def _top(words: np.ndarray, counts: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The HEADS most frequent of distinct words, of equal ones those with the least hashes; words that don't stand are none."""
    first = np.lexsort((words, -counts))[:HEADS]
    first = first[counts[first] > 0]
    out = np.empty(len(first), TOP)
    out["word"], out["count"], out["shape"] = words[first], counts[first], shapes[first]
    return out


def _heads(counts: DataFrame) -> np.ndarray:
    """The most frequent words of all ranges, by hash; some ranges' are merged at a time, and 16 times HEADS come to the driver."""

    def merge(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate([np.frombuffer(r["word"], TOP) for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([_top(every["word"], every["count"], every["shape"]).tobytes()], pa.binary())], ["word"])

    tops = counts.where("kind = 'top'").select((F.col("range") % 16).alias("range"), "word")
    every = np.frombuffer(b"".join(r["word"] for r in _by_range(tops, merge, "word binary").collect()), TOP)
    return np.sort(_top(every["word"], every["count"], every["shape"]), order="word")


def _head_pairs(chunks: DataFrame, heads: np.ndarray) -> np.ndarray:
    """Bigram counts of the end, other words by shape, and ``heads`` (word hashes, ascending)."""
    size = FIRST + len(heads)

    def make(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        of, _ = _head_classes(chunk, heads, FIRST + np.arange(len(heads)))
        path = chunk.numbered(of, 0)[chunk.training()]
        yield _counted(path[:-1] * size + path[1:], size * size)

    return _summed(_each(chunks, make, "pair long, n long"), "pair", "n", size * size).reshape(size, size)


def _head_classes(chunk: Chunk, heads: np.ndarray, of_heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word in the order of hashes, that of its shape where it is no head, and which are heads."""
    of, head = 1 + chunk.shapes.astype(np.int64), np.zeros(len(chunk.hashes), bool)
    here = np.isin(heads, chunk.hashes)
    at = np.searchsorted(chunk.hashes, heads[here])
    of[at], head[at] = of_heads[here], True
    return of, head


# ---- counts beside classes ------------------------------------------------------------------------

#: One count of an item's neighbours: the class before which it stands, or n + the class behind which, or 2n for itself.
ENTRY = np.dtype([("key", "u1"), ("n", "<u2")])
MOST = (1 << 16) - 1


def _entries(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and entries from keys row * width + entry; a count above MOST makes several entries."""
    times = (counts - 1) // MOST + 1
    entries = np.empty(int(times.sum()), ENTRY)
    entries["key"], entries["n"] = np.repeat(keys % width, times), MOST
    entries["n"][np.cumsum(times) - 1] = (counts - 1) % MOST + 1
    return np.repeat(keys // width, times), entries


def _placed(chunks: DataFrame, bits: int, heads: np.ndarray, of_heads: np.ndarray, table: np.ndarray) -> DataFrame:
    """The class of every chunk's words (uint8, by range) after all words with LEAST or more have been exchanged at once.

    A word's own counts beside each class are summed over all chunks; heads keep their classes, rarer words those of their
    shapes. table: class bigrams before. Sums: words of LEAST and more by class.
    """
    n = len(table)
    width = 2 * n + 1

    def send(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        of, head = _head_classes(chunk, heads, of_heads)
        words, path = chunk.training(), None
        path = chunk.numbered(of, 0)[words]
        item = np.full(len(of), -1)
        sent = np.flatnonzero(~head)
        item[sent] = np.arange(len(sent))
        own_item = chunk.numbered(item, -1)[words]
        rows, entries = [np.zeros(0, np.int64)], [np.zeros(0, ENTRY)]
        for lo in range(0, len(sent), 1 << 16):  # a table of some items at a time
            place = np.flatnonzero((own_item >= lo) & (own_item < lo + (1 << 16)))
            base = (own_item[place] - lo) * width
            twice = words[place] == words[place + 1]
            total = np.bincount(np.concatenate([base + path[place + 1], base + n + path[place - 1], base[twice] + 2 * n]), minlength=1)
            keys = np.flatnonzero(total)
            found = _entries(keys, total[keys], width)
            rows.append(found[0] + lo)
            entries.append(found[1])
        rows, entries = np.concatenate(rows), np.concatenate(entries)
        sizes = np.bincount(rows, minlength=len(sent))
        ends = np.cumsum(sizes)
        out = []
        for r, s in chunk.ranges(bits, sent):
            part = entries[(ends[s.start - 1] if s.start else 0) : ends[s.stop - 1]]
            out.append({"chunk": chunk.number, "range": r, "size": int(s.stop - s.start), "hashes": _press(chunk.hashes[sent[s]]), "shapes": _press(chunk.shapes[sent[s]]), "sizes": _press(sizes[s].astype(np.uint32)), "keys": _press(part["key"]), "counts": _press(part["n"])})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("size", pa.int64()), *((c, pa.binary()) for c in ("hashes", "shapes", "sizes", "keys", "counts"))]))

    def add(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        own, first, at = np.unique(np.concatenate([_read(r["hashes"], np.uint64) for r in rows]), return_index=True, return_inverse=True)
        of = 1 + np.concatenate([_read(r["shapes"], np.uint8) for r in rows])[first]
        counts = np.zeros(len(own), np.int64)
        place = [np.repeat(p, _read(r["sizes"], np.uint32)) for r, p in zip(rows, np.split(at, np.cumsum([r["size"] for r in rows])[:-1]), strict=True)]
        place, keys = np.concatenate(place), np.concatenate([_read(r["keys"], np.uint8) for r in rows])
        times = np.concatenate([_read(r["counts"], np.uint16) for r in rows]).astype(np.int64)
        before = keys < n  # every word stands before something once
        counts += np.bincount(place[before], times[before], len(own)).astype(np.int64)
        items = np.flatnonzero(counts >= LEAST)
        number = np.full(len(own), -1)
        number[items] = np.arange(len(items))
        kept = number[place] >= 0
        place, keys, times = number[place[kept]], keys[kept], times[kept]
        order = np.argsort(place, kind="stable")
        place, keys, times = place[order], keys[order], times[order]
        cut = np.searchsorted(place, np.arange(len(items) + 1))
        for i, w in enumerate(items.tolist()):
            part = slice(cut[i], cut[i + 1])
            row = np.bincount(keys[part], times[part], width)
            of[w] = best_class(table, int(of[w]), row[:n], row[n : 2 * n], float(row[2 * n]))
        types, tokens = np.bincount(of[items], minlength=n), np.bincount(of[items], counts[items], n)
        yield _answered(rows, at, of, [{"kind": "class", "class": c, "types": int(types[c]), "tokens": int(tokens[c])} for c in np.flatnonzero(types).tolist()])

    return _by_range(_each(chunks, send, "chunk long, range int, size long, hashes binary, shapes binary, sizes binary, keys binary, counts binary"), add, _answers)


# ---- scores ---------------------------------------------------------------------------------------


def _scored_words(chunks: DataFrame, answers: DataFrame, model: dict, kind: str) -> DataFrame:
    """(id, held, n_tokens, n_known, base, emission, path binary) of every text; path: the classes of its words, a byte each.

    answers: (chunk, range, kind count or class, answer) to every chunk; those of class leave the heads out.
    """

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        replies = sorted(known.to_pylist(), key=lambda r: r["range"])
        for row in texts.to_pylist():
            chunk = Chunk(row)
            of, head = _head_classes(chunk, model["heads"], model["of_heads"])
            counts, classes = (np.concatenate([np.zeros(0, t), *(_read(r["answer"], t) for r in replies if r["kind"] == k)]) for k, t in (("count", np.int64), ("class", np.uint8)))
            of[~head] = classes
            of, counts = chunk.numbered(of, 0), chunk.numbered(counts, model["ends"])
            base = np.log10((counts + 0.5) / (model["total"] + 0.5 * (model["distinct"] + 1)))
            emission = emissions(counts, of, model["tokens"], model["types"])
            cut = np.cumsum(chunk.lengths)
            tokens, begin = np.insert(chunk.words, cut, len(chunk.order)), cut - chunk.lengths + np.arange(len(cut))
            path = of[chunk.words].astype(np.uint8).tobytes()
            sums = [np.add.reduceat(x[tokens], begin) for x in ((counts > 0).astype(np.int64), base, emission)]
            paths = [path[e - n : e] for e, n in zip(cut.tolist(), chunk.lengths.tolist(), strict=True)]
            out.append(pa.table([chunk.docs.column(0), chunk.docs.column(1), pa.array(chunk.lengths + 1), *map(pa.array, sums), pa.array(paths, pa.binary())], names=["id", "held", "n_tokens", "n_known", "base", "emission", "path"]))
        release()
        return pa.concat_tables(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, f"id {kind}, held boolean, n_tokens long, n_known long, base double, emission double, path binary")


def _between_ends(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All paths one after the other, each with an end before and behind it, and where each one's end before it stands."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    cut = np.cumsum(np.append(0, lengths))
    return np.insert(flat, cut, 0), cut[:-1] + np.arange(len(lengths))


def _path_table(paths: DataFrame, n: int) -> np.ndarray:
    """Class bigram counts of the training texts; n * n rows at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in bounded(batches, "path"):
            path, _ = _between_ends(batch.column(0))
            total += np.bincount(path[:-1].astype(np.int64) * n + path[1:], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return _summed(paths.where("not held").select("path").mapInArrow(run, "pair long, n long"), "pair", "n", n * n).reshape(n, n)


def _likelihoods(paths: DataFrame, transitions: np.ndarray, kind: str) -> DataFrame:
    """(id, held, n_tokens, n_known, base, score) from paths and log10 transitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "path"):
            path, begin = _between_ends(batch.column(6))
            moves = np.add.reduceat(transitions[path[:-1], path[1:]], begin)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(batch.column(5).to_numpy() + moves)], ["id", "held", "n_tokens", "n_known", "base", "score"])
        release()

    return paths.select("id", "held", "n_tokens", "n_known", "base", "emission", "path").mapInArrow(run, f"id {kind}, held boolean, n_tokens long, n_known long, base double, score double")


def score(docs: DataFrame, held_out: object, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores of every row by a model of the rows where ``held_out`` is false.

    Columns: the id, held_out boolean, n_tokens, n_known (seen in training), train_tokens (long), base_score (log10 by
    smoothed word frequencies), score (log10 by the class model). A text's tokens are its words between ASCII white
    space, A-Z lower case, then one end; a null or empty text is the end alone. Without training rows both scores
    still exist (nothing is known); an empty table gives an empty result. Repeated rows count as often as they stand, rows
    without an id like others (their fold is ``held_out``'s, null: training); a text of any length is scored whole; other
    columns are not read.

    The chunks are written once to the shared folder and shuffled once, for the scores. At most HEADS
    words, (FIRST + HEADS)^2 pair counts and the class bigrams of a turn come to the driver.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    spark = docs.sparkSession
    bits = max(1, (RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    chunks = materialize(chunked(docs, F.coalesce(held_out, F.lit(False)), id_column, text_column), "chunks")
    counts = materialize(_word_counts(chunks, bits), "counts")
    sums = {(r["kind"], r["class"]): r for r in counts.where("chunk is null and kind in ('shape', 'rare')").groupBy("kind", "class").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()}
    seen = [r for (what, _), r in sums.items() if what == "shape"]
    total, distinct = (sum(r[c] for r in seen) for c in ("tokens", "types"))
    top = _heads(counts)
    heads = top["word"].copy()

    n, pairs = FIRST + CLASSES, _head_pairs(chunks, heads)
    of = exchange(pairs, np.arange(FIRST))
    classes = materialize(_placed(chunks, bits, heads, of[FIRST:], class_table(pairs, of, n)), "classes")

    # the end, then rare words but for heads among them, then the heads and the words exchanged
    ends = int(pairs[:, 0].sum())
    tokens, types = np.zeros(n), np.zeros(n)
    tokens[0], types[0] = ends, min(ends, 1)
    placed = classes.where("kind = 'class'").groupBy("class").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()
    for r in [*(r for (what, _), r in sums.items() if what == "rare"), *placed]:
        tokens[r["class"]] += r["tokens"]
        types[r["class"]] += r["types"]
    for (_, c, shape), own in zip(top.tolist(), of[FIRST:].tolist(), strict=True):
        tokens[own], types[own] = tokens[own] + c, types[own] + 1
        if c < LEAST:
            tokens[1 + shape], types[1 + shape] = tokens[1 + shape] - c, types[1 + shape] - 1

    model = {"heads": heads, "of_heads": of[FIRST:], "ends": ends, "total": total + ends, "distinct": distinct + min(ends, 1), "tokens": tokens, "types": types}
    answers = counts.withColumn("kind", F.lit("count")).unionByName(classes.withColumn("kind", F.lit("class"))).where("chunk is not null").select("chunk", "range", "kind", "answer")
    paths = materialize(_scored_words(chunks, answers, model, kind), "paths")
    for done in (chunks, counts, classes):
        discard(done)
    scored = _likelihoods(paths, transitions_of(_path_table(paths, n)), kind)
    return scored.select(F.col("id").alias(id_column), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model["total"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
