"""Quality by Bradley-Terry pairwise ranking.

Documents have a strength, a weighted sum of surface features of the text. In each preference pair a
document labelled 1 beats one labelled 0 with probability sigmoid(difference of strengths); the weights
maximize the pairs' likelihood. The threshold is a quantile of the strengths of the labelled documents. A
score is the probability of beating a document at the threshold, shifted so that an equal one has CUT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.common import as_bytes, bounded, in_fold, keep_rows

#: Score from which a document is predicted to be of quality.
CUT = 0.7
#: Labelled documents that train at most (taken in the order of a hash), pairs drawn among them, steps of the fit.
LABELLED, PAIRS, STEPS, RIDGE = 20_000, 40_000, 300, 1e-3

SPACES, DIGITS, UPPER, LOWER = b" \t\n\r\x0b\x0c", bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123))
MARKS = [bytes([b]) for b in b"#$%&*!|.,?:;-_/\\<>@=+~^"]
GROUPS = [SPACES, DIGITS, UPPER, LOWER, bytes(range(128, 256)), b"()[]{}", b"\"'`", *MARKS]
MEMBER = np.zeros((256, len(GROUPS)))
for _i, _g in enumerate(GROUPS):
    MEMBER[list(_g), _i] = 1


def features(data: bytes) -> np.ndarray:
    """Surface features of a whole text: shares of byte groups, how words and lines repeat, lengths."""
    n = len(data)
    if not n:
        return np.zeros(2 * len(GROUPS) + 8)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ MEMBER / n
    words = data.split()
    distinct = set(words)
    lines = [x for x in data.split(b"\n") if x]
    w, ls = max(len(words), 1), max(len(lines), 1)
    same = sum(map(bytes.__eq__, words, words[1:])) / w
    more = [
        len(distinct) / w,
        min(1.0, len(distinct) / w**0.75),
        same,
        len(set(lines)) / ls,
        np.log1p(len(words)) / 10,
        min(n / w, 40) / 40,
        min(n / ls, 2000) / 2000,
        float(len(words) < 5),
    ]
    return np.concatenate([shares, np.minimum(shares * 50, 1), more])


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(rows) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> Ranking:
    """Weights from preference pairs by logistic loss on feature differences, then the threshold.

    The threshold is the quantile of the strengths that separates the labels best, halfway to the next strength above.
    Without documents of both labels all strengths are equal and every score is CUT.
    """
    size = rows.shape[1]
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(size), np.ones(size), np.zeros(size), 0.0)
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    x = (rows - mean) / scale
    rng = np.random.default_rng(seed)
    difference = x[rng.choice(good, PAIRS)] - x[rng.choice(bad, PAIRS)]
    w = np.zeros(size)
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        lost = 1 / (1 + np.exp(np.clip(difference @ w, -50, 50)))
        slope = RIDGE * w - (lost @ difference) / len(difference)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    strengths = x @ w
    order = np.argsort(strengths, kind="stable")
    # errors if the k weakest are rejected: label 1 among them, label 0 among the rest
    errors = np.concatenate([[0], np.cumsum(labels[order] == 1)]) + len(bad) - np.concatenate([[0], np.cumsum(labels[order] == 0)])
    k = int(np.argmin(errors))
    ranked = np.concatenate([[strengths.min() - 1], strengths[order], [strengths.max() + 1]])
    return Ranking(mean, scale, w, float((ranked[k] + ranked[k + 1]) / 2))


def labelled_features(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents, in the order of a hash of the id.

    Of several rows with one id the one with the least features counts, so repeated ids don't lift the bound.
    """
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.round(F.avg(label_column)).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64(id_column), id_column).limit(limit)
    texts = docs.select(F.col(id_column), as_bytes(text_column).alias("data")).join(F.broadcast(sample), id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "data"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x).tolist() for x in batch.column(1).to_pylist()], pa.list_(pa.float64())), batch.column(2)], ["id", "x", "label"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = texts.select(F.col(id_column).alias("id"), "data", "label").mapInArrow(run, f"id {kind}, x array<double>, label int")
    found = sorted((r["x"], r["label"]) for r in rows.groupBy("id").agg(F.min("x").alias("x"), F.min("label").alias("label")).collect())
    return np.array([x for x, _ in found]).reshape(len(found), len(features(b""))), np.array([y for _, y in found], int)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", limit: int = LABELLED) -> Ranking:
    """A ranking from labelled documents; ``limit`` bounds what comes to the driver."""
    return fit(*labelled_features(docs, labels, id_column, text_column, label_column, limit))


def score(docs: DataFrame, ranking: Ranking, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (id, score double, predicted int) of every row; a null text is empty and scored as such.

    Only the text counts. Repeated rows give equal scores, an empty table an empty result; a text of any length is scored
    whole; other columns are not read. One narrow stage, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "data"):
            s = ranking.score(np.array([features(x) for x in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), as_bytes(text_column).alias("data")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return rows.withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, ranking: Ranking, text_column: str = "text") -> DataFrame:
    """The rows with a score of at least CUT, with all their columns, whatever their names.

    A null text is scored as an empty one, a text of any length whole; repeated rows share their fate; an empty table gives an
    empty one.
    """

    def decide(texts: pa.Array) -> list[bool]:
        return (ranking.score(np.array([features((t or "").encode()) for t in texts.to_pylist()])) >= CUT).tolist()

    return keep_rows(docs, text_column, decide)


def train_and_score(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of fold ``held_out`` are not learned."""
    ranking = train(docs, labels.where(~in_fold("doc_id", folds, held_out)))
    scored = score(docs, ranking)
    return scored.select("doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "score", "predicted")
