"""Centroid clustering in exact integers, with block norms to leave distances out.

A vector is cut into segments, and the norms of its segments are stored beside it: the compressed vector. By Cauchy and
Schwarz the product of two segments is at most the product of their norms, so the squared distance of a vector and a centroid
is at least the squared distance of their compressed forms. Centroids are taken in the order of this bound; as soon as it
passes the least exact distance found, the rest of them needs no exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.common import discard, materialize
from leadlight.llm.topk import matrix, quantized

#: Components of a segment. Rows that are compared at a time.
SEGMENT, ROWS = 4, 4096


def compressed(vectors: np.ndarray) -> np.ndarray:
    """The norms of the segments of each row; the last segment may be shorter."""
    starts = np.arange(0, vectors.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(vectors.astype(np.float64) ** 2, starts, axis=1))


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed."""
    short = compressed(centroids)
    squares = (norms**2).sum(1)[:, None] + (short**2).sum(1)
    low = squares - 2 * norms @ short.T - 1e-9 * squares  # a little lower, for rounding
    order = np.argsort(low, axis=1, kind="stable")
    cluster, best, computed = np.full(len(vectors), -1), np.full(len(vectors), np.iinfo(np.int64).max), 0
    rows = np.arange(len(vectors))
    for place in range(len(centroids)):
        at = order[rows, place]
        left = low[rows, at] <= best[rows]  # bounds only rise from here on
        rows, at = rows[left], at[left]
        if not len(rows):
            break
        far = ((vectors[rows] - centroids[at]) ** 2).sum(1)
        computed += len(rows)
        nearer = (far < best[rows]) | (far == best[rows]) & (at < cluster[rows])
        best[rows[nearer]], cluster[rows[nearer]] = far[nearer], at[nearer]
    return cluster, best, computed


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, matrix(part.column(1), np.int64), matrix(part.column(2), np.float64)


def compress(vectors: DataFrame, scale: int, dims: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, norms) of the vectors with ``dims`` components that are all finite; v is floor(scale * x)."""
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), quantized(vector_column, scale).alias("v")).where(F.size("v") == dims)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                norms = compressed(matrix(batch.column(1), np.int64))
                ends = pa.array(np.arange(len(norms) + 1, dtype=np.int32) * norms.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(norms.ravel()))], ["id", "v", "norms"])

    return clean.mapInArrow(measure, "id long, v array<long>, norms array<double>")


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the k smallest sha256 of salt and id, in that order; rows that share an id go by their vector."""
    chosen = kept.where("id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("hash"), "id", "v")
    return np.array([r["v"] for r in chosen.orderBy("hash", "id", "v").limit(k).collect()], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of what lies nearest; an empty one stays.

    A task sums up its own rows, so it passes one row for each centroid on, and the driver gets one row for each.
    """
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v, norms in _pieces(batches):
            cluster, _, _ = nearest(v, norms, centroids)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, v)
        ends = pa.array(np.arange(k + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], ["cluster", "n", "total"])

    parts = kept.mapInArrow(sums, "cluster int, n long, total array<long>").where("n > 0")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
    out = centroids.copy()
    for r in found.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["total"]]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster int, distance long, computed int): the nearest centroid and how many exact distances it took (a mean)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, norms in _pieces(batches):
            cluster, far, computed = nearest(v, norms, centroids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), pa.array(far), pa.array(np.full(len(far), computed / len(far)))], ["id", "cluster", "distance", "computed"])

    return kept.mapInArrow(assign, "id long, cluster int, distance long, computed double")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, salt: str = "3:", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Columns (<id>, cluster int, distance, cluster_inertia, inertia long, centroid_sha256 string, computed double) of each kept vector.

    Kept are vectors of ``dims`` components, none null or not finite, as floor(scale * x); squared distances and the sums of a
    cluster must fit a long. The centroids start as the kept vectors with the k smallest sha256 of salt and id; every round
    moves the non-empty ones to floor(sum / count); then all vectors are assigned once more. With fewer vectors than k there
    are fewer centroids. Repeated rows count as often as they stand; a row without an id is assigned but never starts a
    centroid; if no row has an id, or the table is empty, so is the result. Other columns are not read. ``computed`` is the mean
    number of exact distances of the rows compared together. The driver holds k centroids, never rows.
    """
    kept = materialize(compress(vectors, scale, dims, id_column, vector_column), "compressed")
    centroids = first_centroids(kept, k, salt)
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        placed = vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long, computed double")
        facts = vectors.sparkSession.createDataFrame([], names)
    else:
        for _ in range(rounds):
            centroids = moved(kept, centroids)
        placed = materialize(assigned(kept, centroids), "assigned")
        discard(kept)
        inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        facts = vectors.sparkSession.createDataFrame([(c, s, sum(inertia.values()), digests[c]) for c, s in inertia.items()], names)
    out = placed.join(F.broadcast(facts), "cluster")  # k rows
    return out.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")
