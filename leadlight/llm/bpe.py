"""BPE encoding and decoding: exact merges by backtracking, decoding by an offset table.

The encoder never replays merges. An Aho-Corasick pass finds every vocabulary token inside a
pre-token; the longest token at a place is kept if it is compatible with the token before it, else a
shorter one is tried, else the place is marked dead and the token before it is taken back. Two tokens
are compatible if merging their joined symbols by rank leaves exactly these two; the answers are kept
in a table. Each place is marked dead at most once, so the time is linear in the pre-token's length.

Decoding gathers bytes from one blob of all token strings through a table of offsets.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.common import bounded

#: Stands for the word-end suffix inside the encoder; it is no byte symbol.
WORD_END = "\ue000"
#: Distinct units of which a worker keeps the ids.
CACHE_UNITS = 400_000
#: Longer units (texts without spaces) are encoded each time, so a cache holds a bounded number of bytes.
LONG_UNIT = 64


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            symbols[b] = chr(b)
        else:
            symbols[b] = chr(spare)
            spare += 1
    return symbols


class BacktrackingEncoder:
    """Exact BPE over strings of symbols. ``merges`` in rank order; ``suffix`` closes a pre-token's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None = None) -> None:
        self.suffix = suffix or ""
        inner = lambda s: s[: -len(suffix)] + WORD_END if suffix and s.endswith(suffix) else s
        names = {inner(s): i for s, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], bool] = {}
        atoms = {s for s in names if len(s.removesuffix(WORD_END)) == 1}
        for s in atoms:
            self.made_at[names[s]] = -1
        for r, (a, b) in enumerate(merges):
            left, right, whole = names.get(inner(a)), names.get(inner(b)), names.get(inner(a) + inner(b))
            if left is None or right is None or whole is None:
                continue
            self.rank.setdefault((left, right), r)
            # a token that the merges can't reach this way never survives as itself
            if whole not in self.made_at and left in self.made_at and right in self.made_at and self._compatible(left, right, r):
                self.made_at[whole], self.parts[whole] = r, (left, right)
        self.reached = {s: names[s] for s in names if names[s] in self.made_at}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.reached.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()

    def _compatible(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of rank under ``before`` crosses the border of two tokens.

        The merges inside both tokens are undone from the latest to the earliest. At each moment the two symbols at
        the border must not have a merge that comes first; on equal ranks the leftmost place merges first.
        """
        limit = before
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            a, b = self.made_at[left], self.made_at[right]
            if a < 0 and b < 0:
                return True
            if a >= b:
                # the left token's last merge at a rank goes before one across the border at the same rank
                limit, left = min(limit, a), self.parts[left][1]
            else:
                limit, right = min(limit, b + 1), self.parts[right][0]

    def pair_fits(self, left: int, right: int) -> bool:
        known = self.joins.get((left, right))
        if known is None:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            known = self.joins[left, right] = self._compatible(left, right, 1 << 60)
        return known

    def encode(self, symbols: str) -> list[int]:
        """The ids of one pre-token given as symbols, without its suffix."""
        if not symbols:
            return []
        s = symbols + WORD_END if self.suffix else symbols
        whole = self.reached.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(s):
            at[end + 1 - match[0]].append(match)  # ends ascend, so lengths do
        dead = bytearray(n + 1)
        ids: list[int] = []
        places: list[int] = []  # start of each token
        tries: list[int] = []  # how many of the place's matches are left to try
        here, left = 0, len(at[0])
        while here < n:
            matches = at[here]
            while left:
                left -= 1
                size, token = matches[left]
                if not dead[here + size] and (not ids or self.pair_fits(ids[-1], token)):
                    ids.append(token)
                    places.append(here)
                    tries.append(left)
                    here += size
                    left = len(at[here]) if here < n else 0
                    break
            else:
                if not ids:
                    raise ValueError(f"symbols outside the vocabulary: {symbols[:80]!r}")
                dead[here] = 1
                ids.pop()
                here, left = places.pop(), tries.pop()
        return ids


class WordTokenizer:
    """Encoder and decoder of a ``tokenizer.json`` with byte symbols: normalizing, splitting, BPE, special strings.

    Takes a BPE model with byte-level symbols, with or without a word-end suffix, split by a pattern whose matches
    never hold white space, and normalizers NFC, ``\\s+`` to space and lower case.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.encoder = BacktrackingEncoder(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.symbols = byte_symbols()
        names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        strings = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.cache: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        """Ids, as bytes, of a text without white space and special strings."""
        text = unit if unicodedata.is_normalized("NFC", unit) else unicodedata.normalize("NFC", unit)
        # character by character: the lower case of a sigma doesn't depend on its place here
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        ids: list[int] = []
        for word in self.pattern.findall(text):
            ids += self.encoder.encode("".join([self.symbols[b] for b in word.encode()]))
        found = np.array(ids, "<u4").tobytes()
        if len(unit) <= LONG_UNIT:
            self.cache[unit] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        # str.split takes four control characters as white space, which the pattern does not
        units = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else regex.split(r"\p{White_Space}+", text)
        known, miss = self.cache.get, self._unit
        return [known(u) if u in self.cache else miss(u) for u in units]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit numbers."""
        if self.special_pattern is None or "<|" not in text and not self.special_pattern.search(text):
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        parts: list[bytes] = []
        for piece in self.special_pattern.split(text):
            if piece in self.special:
                parts.append(np.array([self.special[piece]], "<u4").tobytes())
            else:
                parts += self._plain(piece)
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The token strings joined with spaces, in UTF-8 (this vocabulary defines no decoder step)."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        starts, sizes = self.offsets[ids], np.diff(self.offsets)[ids] if len(ids) > 20_000 else self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[places].tobytes()[:-1]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_decode(docs: DataFrame, vocab_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (id, ids array<int>, decoded string) of every row.

    A null or empty text has no ids and decodes to the empty string. Repeated rows give repeated rows; other columns
    are not read. One narrow stage: no shuffle, and memory for a few megabytes of text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(vocab_path)
        for batch in bounded(batches, "text", 1 << 20):
            ids = [codec.encode(t) if t else np.zeros(0, "<u4") for t in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([codec.decode(x) for x in ids], pa.binary()).cast(pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return rows.withColumnRenamed("id", id_column)
