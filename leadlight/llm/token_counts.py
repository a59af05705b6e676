"""Token counts by rank-synchronous merging of ragged numpy arrays.

All pre-tokens of a batch that have no known count lie end to end in one array of symbols. In each
round every pre-token finds its lowest-rank pair of neighbours and all of them merge theirs at the same
time (a pre-token's equal pairs from left to right, as BPE does); what has no pair left drops out. The
symbols that survive are counted; ids are never listed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.bpe import LONG_UNIT, byte_symbols
from leadlight.llm.common import bounded

#: The split of byte-level tokenizers whose file says ``use_regex``; a fixed value of the format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1 << 40)
#: Distinct units of which a worker keeps the count.
CACHE_UNITS = 500_000


class RankMerger:
    """Counts of the symbols that byte strings have after all merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.byte_ids = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pairs.setdefault(vocab[a] * int(self.base) + vocab[b], (r, vocab[a + b]))
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], values[order, 0], values[order, 1]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NO_RANK where there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each byte string."""
        result = np.array([len(w) for w in words], np.int64)
        alive = np.flatnonzero(result > 1)
        if not len(alive):
            return result
        symbols = self.byte_ids[np.frombuffer(b"".join([words[i] for i in alive]), np.uint8)]
        word = np.repeat(alive, result[alive])
        ranks, made = self._lookup(symbols[:-1], symbols[1:])
        ranks = np.append(np.where(word[:-1] == word[1:], ranks, NO_RANK), NO_RANK)
        made = np.append(made, 0)
        while True:
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(ranks, starts)
            result[word[starts]] = sizes
            going = lowest < NO_RANK
            if not going.any():
                return result
            keep = np.repeat(going, sizes)
            if not going.all():
                symbols, word, ranks, made, lowest, sizes = symbols[keep], word[keep], ranks[keep], made[keep], lowest[going], sizes[going]
            hit = ranks == np.repeat(lowest, sizes)
            # of overlapping equal pairs (a run of one symbol) every second one merges, from the left
            places = np.flatnonzero(hit)
            if len(places) > 1:
                fresh = np.append(True, np.diff(places) > 1)
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            symbols[places] = made[places]
            left = np.ones(len(symbols), bool)
            left[places + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[places] = True
            symbols, word, ranks, made, changed = symbols[left], word[left], ranks[left], made[left], changed[left]
            # only pairs that touch a merged symbol have new ranks
            touch = np.flatnonzero(changed | np.append(changed[1:], False))
            touch = touch[touch < len(symbols) - 1]
            new_ranks, new_made = self._lookup(symbols[touch], symbols[touch + 1])
            ranks[touch] = np.where(word[touch] == word[touch + 1], new_ranks, NO_RANK)
            made[touch] = new_made
            ranks[-1] = NO_RANK


class TokenCounter:
    """Counts of whole texts for a byte-level ``tokenizer.json``.

    Texts are cut at single spaces into units, each with the space before it; the pattern never joins two of them
    unless white space meets white space. Such texts go through the pattern whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merger = RankMerger(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.edge = regex.compile(r"^\p{White_Space}|\p{White_Space}$")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.units: dict[str, int] = {}

    def _learn(self, units: set[str]) -> None:
        """Count new units (with the space before each) in one ragged batch."""
        cut = [(u, self.pattern.findall(u)) for u in units]
        words = list({w for _, ws in cut for w in ws})
        count = dict(zip(words, self.merger.counts([w.encode() for w in words]).tolist(), strict=True))
        self.units.update((u, sum([count[w] for w in ws])) for u, ws in cut)

    def counts(self, texts: list[str | None]) -> list[int]:
        """The token count of each text; null as empty."""
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        totals, pieces = [0] * len(texts), []
        for i, text in enumerate(texts):
            parts = [text or ""]
            for s in self.special:
                if s in parts[0] or len(parts) > 1:
                    split = [p.split(s) for p in parts]
                    totals[i] += sum(len(p) - 1 for p in split)
                    parts = [x for p in split for x in p]
            pieces += [(i, p) for p in parts if p]
        units = []
        for _, p in pieces:
            first, *rest = p.split(" ")
            units.append([first, *[" " + u for u in rest]] if rest else [first])
        new = set().union(*units).difference(self.units)
        irregular = {u for u in new if self.edge.search(u[1:] if u[:1] == " " else u) or u in (" ", "")}
        self.units.update(dict.fromkeys(irregular, -1 << 60))
        self._learn(new - irregular)
        get = self.units.__getitem__
        odd = []
        for k, (i, p) in enumerate(pieces):
            n = sum(map(get, units[k]))
            if n < 0:
                odd.append((i, self.pattern.findall(p)))
            else:
                totals[i] += n
        if odd:
            words = list({w for _, ws in odd for w in ws})
            count = dict(zip(words, self.merger.counts([w.encode() for w in words]).tolist(), strict=True))
            for i, ws in odd:
                totals[i] += sum([count[w] for w in ws])
        for u in new:  # long units are not kept, so the cache holds a bounded number of bytes
            if len(u) > LONG_UNIT:
                del self.units[u]
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocab_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (id, n_bytes long, n_tokens long) of every row; a null or empty text has none of either.

    Repeated rows give repeated rows, an empty table an empty result; a text of any length is counted whole, in memory of
    some times its size; other columns are not read. One narrow stage without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            n = counter(vocab_path).counts(batch.column(1).to_pylist())
            size = pc.binary_length(batch.column(1)).cast(pa.int64()).fill_null(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return rows.withColumnRenamed("id", id_column)
