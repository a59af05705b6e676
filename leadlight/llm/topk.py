"""Exact top-k by inner product with a pivot table.

Each vector gets one more component, sqrt(M - |x|^2) with M the largest squared length; a query gets 0.
Then |q - x|^2 = |q|^2 + M - 2 q.x, so high scores are near neighbours and the triangle inequality
holds: the distances of q and x to one pivot differ by |q - x| at most. The rows carry their distances to
many pivots. For a query and a block of rows the largest difference over the pivots bounds each score from
above; rows are scored in the order of their bounds until no bound reaches the k-th score found. Where that search starts
it knows each query's k-th best score among PIVOT_SAMPLE rows, so every block has a threshold at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows among which pivots are chosen (by hash), rows of a data block and of a query block, rows scored between two stops.
PIVOT_SAMPLE, DATA_BLOCK, QUERY_BLOCK, STEP = 2048, 4096, 1024, 256
EXACT = 1 << 52


def quantized(vector: str, scale: int) -> object:
    """floor(scale * x) of each component as long; null where a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.col(vector).isNotNull() & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    at, far, chosen = int(np.argmax((sample**2).sum(1))), np.full(len(sample), np.inf), []
    for _ in range(min(n, len(sample))):
        chosen.append(at)
        far = np.minimum(far, ((sample - sample[at]) ** 2).sum(1))
        at = int(np.argmax(far))
    return sample[chosen]


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([rows, np.sqrt(np.maximum(longest - (rows**2).sum(1), 0))])


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def thresholds(q_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score among some rows but its own; no score below it is among its k best."""
    scores = asked @ sample.T
    least = np.finfo(np.float64).min if scores.dtype == np.float64 else np.iinfo(np.int64).min
    scores[q_ids[:, None] == ids] = least
    return np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(asked), least, scores.dtype)


def search_block(queries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], longest: float, k: int, sample: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of a block for each query, ties to the smaller id.

    Rows that cannot reach a query's k-th best score among ``sample`` (ids, vectors) may be left out.

    Both sides are (ids, integer vectors, distances to the pivots). A query's own id is no candidate.
    """
    q_ids, q_vectors, q_far = queries
    ids, vectors, far = rows
    largest = max(float(np.abs(x).max(initial=0)) for x in (vectors, *([sample[1]] if sample else [])))
    reach = float(np.abs(q_vectors).max(initial=0)) * largest * vectors.shape[1]
    kind = np.float64 if reach < EXACT else np.int64  # the float product is exact below 2^53
    data, asked = vectors.astype(kind), q_vectors.astype(kind)
    found = []
    if sample is None:
        floors = np.full(len(asked), -np.inf)
    else:
        floors = thresholds(q_ids, asked, sample[0], sample[1].astype(kind), k)
    for q_id, q, q_pivots, floor in zip(q_ids.tolist(), asked, q_far, floors, strict=True):
        low = np.abs(far - q_pivots).max(1) if far.shape[1] else np.zeros(len(ids))
        top = (q.astype(np.float64) ** 2).sum() + longest
        bound = (top - low**2) / 2 + 1e-9 * top + 1  # a little higher, for rounding
        order = np.argsort(-bound, kind="stable")
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(order), STEP):
            part = order[start : start + STEP]
            if bound[part[0]] < max(floor, best[-1] if len(best) == k else floor):
                break
            part = part[ids[part] != q_id]
            scores = (data[part] @ q).astype(np.int64)
            best_ids, best = np.concatenate([best_ids, ids[part]]), np.concatenate([best, scores])
            keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
        found += [(q_id, i, s) for i, s in zip(best_ids.tolist(), best.tolist(), strict=True)]
    return found


def top_k(vectors: DataFrame, is_query: object, k: int = 10, scale: int = 1024, pivots: int = 24, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k best rows of all for each row where ``is_query`` holds: (query_id, rank int, <id>, score), all long but rank.

    Components are floor(scale * x); scores must fit a long. Rows whose id or vector is null, or whose vector has null
    or non-finite components, take no part; a vector meets only vectors of its own size. Rows that share an id are
    all candidates of other queries but never of that id; of several query rows with one id the smallest vector asks. Queries and rows meet in
    blocks, each pair of blocks in a task of its own; at most PIVOT_SAMPLE rows come to the driver.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_column).cast("long").alias("id"), quantized(vector_column, scale).alias("v"), is_query.alias("q")).where("id is not null and v is not null and size(v) > 0")
    length = lambda: F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    seen = clean.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("q").alias("queries"), F.max(length()).alias("longest"))
    out = None
    for size in sorted(seen.where("queries > 0").collect()):
        part = _top_k_of_size(clean.where(F.size("v") == size["dim"]), size["n"], size["queries"], size["longest"], k, pivots)
        out = part if out is None else out.unionByName(part)
    empty = spark.createDataFrame([], "query_id long, id long, score long")
    ranked = (out if out is not None else empty).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def _top_k_of_size(clean: DataFrame, n: int, n_queries: int, longest: float, k: int, pivots: int) -> DataFrame:
    taken = clean.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_SAMPLE).collect()
    known = np.array([r["id"] for r in taken], np.int64), np.array([r["v"] for r in taken], np.int64)
    sample = known[1].astype(np.float64)
    chosen = choose_pivots(lifted(sample, longest), pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (chosen**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(1), np.float64)

            def far(points: np.ndarray) -> pa.Array:
                d = np.sqrt(np.maximum((points**2).sum(1)[:, None] + squares - 2 * points @ chosen.T, 0))
                return pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))

            own = far(np.column_stack([rows, np.zeros(len(rows))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, far(lifted(rows, longest)), own], ["id", "v", "q", "far", "far_q"])

    measured = clean.mapInArrow(measure, "id long, v array<long>, q boolean, far array<double>, far_q array<double>")
    n_data, n_asked = -(-n // DATA_BLOCK), -(-n_queries // QUERY_BLOCK)
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = measured.select("id", "v", "far", F.pmod(F.xxhash64("id", "v"), F.lit(n_data)).alias("db"), blocks(n_asked).alias("qb"))
    asked = measured.where("q").groupBy("id").agg(F.min(F.struct("v", F.col("far_q").alias("far"))).alias("least"))
    asked = asked.select("id", "least.*", F.pmod(F.xxhash64("id"), F.lit(n_asked)).alias("qb"), blocks(n_data).alias("db"))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        sides = []
        for side in (queries, rows):
            side = side.combine_chunks()
            cols = [side.column(c).chunk(0) if side.num_rows else None for c in ("id", "v", "far")]
            sides.append((cols[0].to_numpy(), matrix(cols[1], np.int64), matrix(cols[2], np.float64)) if side.num_rows else None)
        found = search_block(*sides, longest, k, known) if all(sides) else []
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    return asked.groupBy("qb", "db").cogroup(data.groupBy("qb", "db")).applyInArrow(search, "query_id long, id long, score long")
