"""License notices in texts: exact phrases and short notices with a few wrong characters.

A text becomes its words (lower-case A-Z, digits, anything above ASCII) joined by single spaces. Exact
phrases are found there at word borders. A fuzzy notice with at most k edits must hold one of the k + 1
pieces of its text unchanged; these seeds are searched exactly, and only around them the regex library
matches the whole notice with at most k edits, from the border of a word to that of another, so "permit license" holds no
"mit license". Matches with fewer edits are taken first, then those with more
in what is left between them, so that neighbouring notices do not hide each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.common import as_bytes, bounded

#: Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices searched with errors, and their labels; one edit is allowed for every ten characters.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license": "apache",
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
}
EDIT_EVERY = 10
#: What every byte becomes: A-Z lower case, word characters themselves, the rest a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(data: bytes) -> bytes:
    """The words of a text, lower case, joined by single spaces."""
    return b" ".join(data.translate(FOLD).split())


class Notice:
    """One notice: its seeds with their places in it and the patterns that verify it, by edits."""

    def __init__(self, text: str, label: str) -> None:
        self.label, self.size = label, len(text)
        self.edits = len(text) // EDIT_EVERY
        cuts = [len(text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        literal = regex.escape(text.encode(), literal_spaces=True)
        self.patterns = [regex.compile(rb" (?:%s)%s(?= )" % (literal, b"{e<=%d}" % e if e else b"")) for e in range(self.edits + 1)]

    def spans(self, words: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches, not overlapping, each from a word's start to a word's end."""
        padded = b" " + words + b" "
        around = []
        for seed, place in self.seeds:
            at = padded.find(seed)
            while at >= 0:
                # from a space to a space, both included
                end = padded.find(b" ", min(at - place + self.size + self.edits, len(padded) - 1))
                around.append((padded.rfind(b" ", 0, max(1, at - place - self.edits + 1)), end + 1))
                at = padded.find(seed, at + 1)
        around.sort()
        parts: list[tuple[int, int]] = []
        k = 0
        while k < len(around):
            start, end = around[k]
            while k < len(around) and around[k][0] < end:
                end, k = max(end, around[k][1]), k + 1
            parts.append((start, end))
        found: list[tuple[int, int, int]] = []
        for pattern in self.patterns:
            left = []
            for start, end in parts:
                for m in pattern.finditer(padded, start, end):
                    found.append((m.start(), m.end() - 1, sum(m.fuzzy_counts)))
                    left.append((start, m.start() + 1))
                    start = m.end()
                left.append((start, end))
            parts = [(start, end) for start, end in left if end - start >= self.size - self.edits + 2]
        return sorted(found)


@lru_cache(maxsize=8)
def compiled(notices: tuple[tuple[str, str], ...]) -> list[Notice]:
    return [Notice(text, label) for text, label in notices]


def exact_places(words: bytes, phrase: str) -> list[int]:
    """Byte offsets at which the phrase's words stand consecutively."""
    needle, found = phrase.encode(), []
    at = words.find(needle)
    while at >= 0:
        end = at + len(needle)
        if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
            found.append(at)
        at = words.find(needle, at + 1)
    return found


PLACES = "array<struct<label:string,word:bigint>>"
SPANS = "array<struct<label:string,start:bigint,stop:bigint,edits:int,matched:string>>"
PLACE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())]))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (id, n_words long, places, spans, score double) of every row.

    places: each exact phrase's label and the number of its first word; spans: each fuzzy match's label, its bytes
    from start to stop in the normalized text, its edits and what it matched; score: the best match's share of right
    characters, 1 with an exact phrase, 0 without a match. A null or empty text, or one without words, has empty
    lists. Repeated rows give repeated rows, an empty table an empty result; a text of any length is scanned whole; other
    columns are not read. One narrow stage without a shuffle.
    """
    phrases = PHRASES if phrases is None else phrases
    kept = tuple((NOTICES if notices is None else notices).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "data"):
            columns: list[list] = [[], [], [], []]
            for data in batch.column(1).to_pylist():
                words = normal(data)
                gaps = None
                places, spans, score = [], [], 0.0
                for phrase, label in phrases.items():
                    for at in exact_places(words, phrase):
                        if gaps is None:
                            gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
                        places.append({"label": label, "word": int(np.searchsorted(gaps, at))})
                for notice in compiled(kept):
                    for start, stop, edits in notice.spans(words):
                        spans.append({"label": notice.label, "start": start, "stop": stop, "edits": edits, "matched": words[start:stop].decode(errors="replace")})
                        score = max(score, 1 - edits / notice.size)
                for column, value in zip(columns, (words.count(b" ") + 1 if words else 0, places, spans, 1.0 if places else score), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), PLACE_TYPE, SPAN_TYPE, pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_words", "places", "spans", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), as_bytes(text_column).alias("data")).mapInArrow(run, f"id {kind}, n_words long, places {PLACES}, spans {SPANS}, score double")
    return rows.withColumnRenamed("id", id_column)
