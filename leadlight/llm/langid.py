"""Language identification by a byte convolutional network in numpy.

Every byte has a small learned vector. Filters of several widths run over a window of fixed length, each
keeps its largest response, and a softmax over these gives the language. A text is cut into windows from
its first byte to its last; their probabilities are averaged by length. Training takes labelled windows
and plain gradient steps; for prediction the byte vectors and filters are folded into tables of byte
pairs, so a batch of windows needs look-ups and sums only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.llm.common import bounded, in_fold, keep_rows

#: Bytes of a window, size of a byte's vector, filter widths, filters of each width.
WINDOW, VECTOR, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 8
#: Training texts of a language (in the order of a hash) and windows of a text, at most; passes; windows of a step.
TEXTS, TEXT_WINDOWS, PASSES, STEP = 250, 4, 8, 64
#: Languages that are learned at most, those with the most labelled texts.
LANGUAGES = 256
#: Windows that prediction holds at a time.
BLOCK = 256
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, lower case, the last one filled with zeros, and how many bytes of each are the text's."""
    n = max(1, -(-len(data) // WINDOW))
    rows = np.frombuffer(data.translate(LOWER).ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return rows, sizes


@dataclass
class Network:
    languages: list[str]
    vectors: np.ndarray
    filters: dict[int, np.ndarray]  # of each width: (width * VECTOR, FILTERS)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    tables: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}

    def _tables(self) -> dict[int, list[tuple[int, bool, np.ndarray]]]:
        """Of each width the parts (offset, whether of a byte pair, table); their sum is a filter's response."""
        if not self.tables:
            for width, weights in self.filters.items():
                single = [(self.vectors @ weights[j * VECTOR : (j + 1) * VECTOR]).astype(np.float32) for j in range(width)]
                single[0] = single[0] + self.biases[width].astype(np.float32)
                parts = [(j, True, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)) for j in range(0, width - 1, 2)]
                self.tables[width] = parts + ([(width - 1, False, single[-1])] if width % 2 else [])
        return self.tables

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each window."""
        byte = rows.astype(np.int32)
        pair = byte[:, :-1] * 256 + byte[:, 1:]
        found = []
        for width, parts in self._tables().items():
            n = WINDOW - width + 1
            total = None
            for at, paired, table in parts:
                part = np.take(table, (pair if paired else byte)[:, at : at + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            found.append(np.maximum(total.max(axis=1), 0))
        return np.concatenate(found, axis=1)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        logits = np.concatenate([self.responses(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(rows: np.ndarray, labels: list[str], seed: int = 11) -> Network:
    """A network from windows and their languages; each language weighs the same. Without windows it knows none."""
    languages = sorted(set(labels))
    k, rng = len(languages), np.random.default_rng(seed)
    params = {"e": rng.normal(0, 0.5, (256, VECTOR)), "o": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, k)), "ob": np.zeros(k)}
    for w in WIDTHS:
        params[f"f{w}"], params[f"b{w}"] = rng.normal(0, 1 / np.sqrt(w * VECTOR), (w * VECTOR, FILTERS)), np.zeros(FILTERS)
    y = np.searchsorted(languages, labels) if k else np.zeros(0, int)
    weight = 1 / np.bincount(y, minlength=k)[y] * len(y) / max(k, 1) if k else np.zeros(0)
    first, second, step = {n: 0.0 for n in params}, {n: 0.0 for n in params}, 0
    for _ in range(PASSES if k > 1 else 0):
        order = rng.permutation(len(y))
        for start in range(0, len(y), STEP):
            at = order[start : start + STEP]
            b, byte = len(at), rows[at]
            x = params["e"][byte]
            pooled, places = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                response = sum(x[:, j : j + n] @ params[f"f{w}"][j * VECTOR : (j + 1) * VECTOR] for j in range(w)) + params[f"b{w}"]
                places.append(response.argmax(1))
                pooled.append(np.maximum(np.take_along_axis(response, places[-1][:, None], 1)[:, 0], 0))
            hidden = np.concatenate(pooled, 1)
            logits = hidden @ params["o"] + params["ob"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), y[at]] -= 1
            p *= weight[at][:, None] / b
            slope = {n: np.zeros_like(v) for n, v in params.items()}
            slope["o"], slope["ob"] = hidden.T @ p + 1e-4 * params["o"], p.sum(0)
            back = p @ params["o"].T * (hidden > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                slope[f"b{w}"] = g.sum(0)
                for j in range(w):
                    place = places[i] + j
                    bytes_there = np.take_along_axis(byte, place, 1)
                    slope[f"f{w}"][j * VECTOR : (j + 1) * VECTOR] = np.einsum("bfv,bf->vf", params["e"][bytes_there], g)
                    np.add.at(slope["e"], bytes_there, g[..., None] * params[f"f{w}"][j * VECTOR : (j + 1) * VECTOR].T)
            step += 1
            for n, s in slope.items():
                first[n], second[n] = 0.9 * first[n] + 0.1 * s, 0.99 * second[n] + 0.01 * s**2
                params[n] = params[n] - 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    return Network(languages, params["e"], {w: params[f"f{w}"] for w in WIDTHS}, {w: params[f"b{w}"] for w in WIDTHS}, params["o"], params["ob"])


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", texts: int = TEXTS, languages: int = LANGUAGES) -> Network:
    """A network from labelled rows: of each language at most ``texts`` texts, and TEXT_WINDOWS windows spread over each.

    Learned are the ``languages`` labels that most rows have, equal ones by name, so what reaches the driver is bounded.

    Rows whose text or language is null, or whose text has no letter, teach nothing. Of several rows with one id and language
    the one with the least windows counts, so repeated ids don't lift the bound. An empty table gives a network that
    knows no language.
    """
    known = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    common = known.groupBy(F.col(lang_column).alias("common")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "common").limit(languages).select("common")
    known = known.join(F.broadcast(common), F.col(lang_column) == F.col("common"), "left_semi")  # ``languages`` rows at most
    order = W.partitionBy("lang").orderBy("h", "id")
    ids = known.select(F.col(lang_column).alias("lang"), F.col(id_column).alias("id"), F.xxhash64(id_column).alias("h"))
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts).select("id").distinct()
    sample = known.select(F.col(lang_column).alias("lang"), F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("data")).join(F.broadcast(chosen), "id").select("lang", "id", "data")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "data"):
            found = []
            for data in batch.column(2).to_pylist():
                rows, _ = windows(data)
                picked = np.unique(np.linspace(0, len(rows) - 1, TEXT_WINDOWS).round().astype(int))
                found.append([rows[i].tobytes() for i in picked])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["lang", "id", "windows"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = sample.mapInArrow(cut, f"lang string, id {kind}, windows array<binary>").groupBy("lang", "id").agg(F.min("windows").alias("windows"))
    found = sorted((r["lang"], bytes(w)) for r in picked.collect() for w in r["windows"])
    rows = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    return fit(rows, [name for name, _ in found])


@lru_cache(maxsize=2)
def _loaded(pickled: bytes) -> Network:
    return pickle.loads(pickled)


def label(network: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its mean probability over the text's windows, weighted by their bytes."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    asked = [i for i, t in enumerate(texts) if t and network.languages and LETTER.search(t)]
    if asked:
        cut = [windows(texts[i].encode()) for i in asked]
        p = network.probabilities(np.concatenate([r for r, _ in cut])) * np.concatenate([s for _, s in cut])[:, None]
        starts = np.cumsum([0] + [len(s) for _, s in cut[:-1]])
        mean = np.add.reduceat(p, starts, axis=0) / np.array([s.sum() for _, s in cut])[:, None]
        for i, row in zip(asked, mean, strict=True):
            best = int(row.argmax())
            lang[i], score[i] = network.languages[best], min(1.0, row[best])
    return lang, score


def predict(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (id, lang_pred string, score double) of every row.

    score is the mean probability of the predicted language; ties go to the first language by name. A null text, one
    without a letter, and any text if no language was learned get ``und`` with score 0. Repeated rows give repeated
    rows; a text of any length is read whole, in windows. Other columns are not read. One
    narrow stage without a shuffle.
    """
    model = pickle.dumps(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            lang, score = label(_loaded(model), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return rows.withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, network: Network, least: float = 0.4, text_column: str = "text") -> DataFrame:
    """The rows whose language is known with a probability of at least ``least``, with all their columns.

    Without a learned language all rows with a letter stay. A null or empty text and one without a letter go; a text of any length
    is read whole; repeated rows share their fate; an empty table gives an empty one. Column names may be any.
    """
    model = pickle.dumps(network)

    def decide(texts: pa.Array) -> list[bool]:
        net, rows = _loaded(model), texts.to_pylist()
        if not net.languages:
            return [bool(t and LETTER.search(t)) for t in rows]
        lang, score = label(net, rows)
        return [name != UNKNOWN and s >= least for name, s in zip(lang, score.tolist(), strict=True)]

    return keep_rows(docs, text_column, decide)


def train_and_predict(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; rows of fold ``held_out`` are not learned."""
    network = train(docs.where(~in_fold("doc_id", folds, held_out)))
    out = predict(docs, network)
    return out.select("doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "lang_pred", "score")
