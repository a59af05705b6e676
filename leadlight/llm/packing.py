"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Best fit decreasing looks only at lengths, of which there are at most as many as a sequence has
tokens. So the driver needs a histogram, not the documents: it takes the lengths in descending order,
finds the tightest open bin through a segment tree over remaining capacities, and places all pieces of
one length at once, bins with equal contents being one entry. The plan's entries give runs of bins to
runs of ranks within a length; executors rank their pieces and look their places up.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadlight.llm.bpe import LONG_UNIT
from leadlight.llm.common import bounded, materialize, release

#: Pieces of one length that one window group ranks; more are split into further groups.
RANK_GROUP = 500
#: Distinct units of which a worker keeps the ids, within a task and from task to task.
CACHE_UNITS, KEPT_UNITS = 600_000, 200_000
#: New units that the library gets as one string.
JOINED = 1000


class CapacityTree:
    """Segment tree over the capacities 0..size that answers: the smallest capacity >= x that has an open bin."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def put(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.leaves
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        if self.open[node]:
            return least
        while node > 1:  # up to the first right neighbour with an open leaf, then down its left side
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over a histogram {length: pieces}, 1 <= length <= capacity.

    Entries (length, first rank, pieces in each bin, first bin, offset): pieces of that length from that rank on go,
    so many to each bin, into consecutive bins from that one, the first of a bin at that offset.
    """
    tree, bins, entries, used = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def shelve(left: int, first: int, n: int) -> None:
        if n:
            bins[left].append((first, n))
            tree.put(left, True)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                per = capacity // length
                left, first, n = capacity, used, -(-todo // per)
                used += n
            else:
                first, n = bins[left].pop()
                if not bins[left]:
                    tree.put(left, False)
            per = left // length
            full = min(n, todo // per)
            if full:
                entries.append((length, rank, per, first, capacity - left))
                shelve(left - per * length, first, full)
                rank, todo, first, n = rank + full * per, todo - full * per, first + full, n - full
            if n and todo:  # fewer than fill a bin are left
                entries.append((length, rank, todo, first, capacity - left))
                shelve(left - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            shelve(left, first, n)
    return entries


class UnitEncoder:
    """Ids by the tokenizers library, with known units (a word and the space before it) looked up.

    A text is cut at single spaces; new units, all but a text's first, go through the library joined into one string
    with their spaces, and its ids are dealt out by the bytes of each token. Where white space meets white space, or a special string
    stands, the library takes the whole text. For byte-level vocabularies whose pattern cuts before a single space.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        sizes = {i: len(t) for t, i in self.library.get_vocab(with_added_tokens=False).items()}  # a symbol for each byte
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)])
        self.units: dict[str, bytes | None] = {}
        self.marks = {m: self._whole(m) for m in ",.;:!?"}

    def trim(self, most: int) -> None:
        """Forget all but the first units; frequent ones come early."""
        if len(self.units) > most:
            self.units = dict(islice(self.units.items(), most))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        # a unit that is empty or has white space at an edge says that its text is no plain one
        plain = [u for u in new if u and not (u[0].isspace() or u[-1].isspace())]
        self.units.update(dict.fromkeys(new))
        # a mark after a letter or digit is always a token of its own: the word before it is looked up, too
        marked = [u for u in plain if u[-1] in self.marks and u[-2:-1].isalnum()]
        learned = list({u for u in plain if not (u[-1] in self.marks and u[-2:-1].isalnum())}.union([u[:-1] for u in marked if self.units.get(u[:-1]) is None]))
        if learned:
            joined = [" " + " ".join(learned[i : i + JOINED]) for i in range(0, len(learned), JOINED)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(u.encode()) + 1 for u in learned])) + 1
            data, start = ids.tobytes(), 0
            for unit, end in zip(learned, (4 * ends).tolist(), strict=True):
                self.units[unit] = data[start:end]
                start = end
        for unit in marked:
            self.units[unit] = self.units[unit[:-1]] + self.marks[unit[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.units) > CACHE_UNITS:
            self.trim(CACHE_UNITS * 2 // 3)
        cut = [None if not t or any(s in t for s in self.special) else t.split(" ") for t in texts]
        firsts = [c[0] for c in cut if c]
        for c in filter(None, cut):
            del c[0]
        new = set().union(*filter(None, cut)).difference(self.units)
        self._learn(new)
        heads = iter([np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(firsts, add_special_tokens=False)])
        get, out = self.units.__getitem__, []
        for text, units in zip(texts, cut, strict=True):
            if units is None:
                out.append(self._whole(text) if text else b"")
                continue
            head = next(heads)
            try:
                # white space at the end of the first unit would join with the space after it
                out.append(head + b"".join(map(get, units)) if text[0] != " " and not (units and text[text.index(" ") - 1].isspace()) else self._whole(text))
            except TypeError:
                out.append(self._whole(text))
        for u in new:  # long units are not kept, so the cache holds a bounded number of bytes
            if len(u) > LONG_UNIT:
                self.units.pop(u, None)
                self.units.pop(u[:-1], None)
        return out


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def encode_pieces(docs: DataFrame, vocab_path: str, capacity: int, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document's ids and end id: (id, piece, start, length, ids_crc32[, ids]).

    A document of at most ``capacity`` ids is one piece; a longer one is cut so that only piece 0 may be shorter.
    A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in bounded(batches, "text"):
            rows: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(batch.column(0).to_pylist(), unit_encoder(vocab_path).encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                stop, piece = len(ids) % width or width, 0
                start = 0
                while start < len(ids):
                    part = ids[start:stop]
                    for column, value in zip(rows, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + width, piece + 1
            arrays = [pa.array(c, k) for c, k in zip(rows, (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])
        unit_encoder(vocab_path).trim(KEPT_UNITS)  # what a worker holds until its next task
        release()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it.

    Columns: the id, piece int, start, length, ids_crc32, [ids,] sequence_id, offset (long). Each sequence holds its
    pieces without gaps from 0. Repeated rows are packed each on their own, rows without an id like others; an empty table
    gives no rows; which of several pieces of one length stands where is any. Text is read
    once; the pieces go through the shared folder, since the histogram comes before the places. To the driver go at
    most ``capacity`` rows; one shuffle moves rows of a few numbers.
    """
    encoded = encode_pieces(docs, vocab_path, capacity, end_id, id_column, text_column, with_ids)
    pieces = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries = sorted(plan(histogram, capacity))
    spread = [1] + [-(-histogram.get(n, 0) // RANK_GROUP) or 1 for n in range(1, capacity + 1)]

    # ranks within a length: place in a group by a hash of the row's number, plus the pieces of the groups before
    group = F.pmod(F.xxhash64("row"), F.element_at(F.lit(spread), (F.col("length") + 1).cast("int")).cast("long"))
    keyed = pieces.withColumn("group", group)
    before = keyed.groupBy("length", "group").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("group")) - F.col("n")).drop("n")
    within = F.row_number().over(W.partitionBy("length", "group").orderBy("row")) - 1
    ranked = keyed.withColumn("rank", within.cast("long")).join(before, ["length", "group"]).withColumn("rank", F.col("rank") + F.col("before"))

    table = np.array(entries, np.int64).reshape(-1, 5)
    firsts = table[:, 0] << 44 | table[:, 1]
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
                _, first_rank, per, first_bin, offset = table[np.searchsorted(firsts, length << 44 | rank, "right") - 1].T
                bins, slot = np.divmod(rank - first_rank, per)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(first_bin + bins), pa.array(offset + slot * length)], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    out = ranked.select(*names, "rank").mapInArrow(place, ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)
