"""Hard negatives by inverted lists with radii.

Every row lies in the list of its nearest centroid, and each list keeps the largest distance of its rows to the centroid. By
Cauchy and Schwarz the inner product of an anchor and a row of a list is within |anchor| * radius of the one with the centroid. An
anchor has goals, each asking for the k best scores within a window: one for its positives, then one for each positive's
negatives. It visits its list with the highest upper bound first; the k-th scores found there come along to the others. A list
is skipped when its bounds lie outside all windows, or its upper bound is strictly below all k-th scores found so far.

Lists are packed into shards, large ones cut into chunks, so that a task holds DATA_BLOCK rows or so; anchors come to a shard in
blocks, and only where a bound reaches. Among the lists of a shard those with the highest bounds go first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.llm.common import materialize
from leadlight.llm.topk import EXACT, matrix, quantized

#: Rows (by hash) on which the centroids are fitted, lists at most, rows of a list aimed at.
SAMPLE, LISTS, LIST_ROWS = 8192, 512, 128
#: Rows of a shard, anchors of a block, anchors scored together.
DATA_BLOCK, ANCHOR_BLOCK, STEP = 4096, 1024, 256
#: Pairs of shard chunk and anchor block that may be broadcast; beyond that they are joined by shuffle.
BROADCAST = 100_000
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass
class Index:
    """Centroids, radius and shard of every list, and the chunks of every shard."""

    centroids: np.ndarray
    radius: np.ndarray
    shard: np.ndarray
    chunks: np.ndarray

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest possible score of each anchor with each list, a little wide for rounding."""
        middle = anchors @ self.centroids.T
        length = np.sqrt((anchors**2).sum(1))[:, None]
        reach = length * self.radius + 1e-9 * length * (self.radius + np.sqrt((self.centroids**2).sum(1))) + 1e-3
        return middle + reach, middle - reach


def fit(sample: np.ndarray, k: int, turns: int = 8) -> np.ndarray:
    """Centroids of k-means from rows drawn with a fixed seed."""
    rows = np.unique(sample, axis=0)
    centroids = rows[np.random.default_rng(k).permutation(len(rows))[:k]]
    for _ in range(turns):
        near = _nearest(sample, centroids)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * rows @ centroids.T).argmin(1)


def shards(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each list and the chunks of each shard: neighbours share one up to ``block`` rows, a larger list is cut."""
    shard, chunks, held = np.zeros(len(counts), np.int32), [], block + 1
    for i, n in enumerate(counts.tolist()):
        if held + n > block:
            chunks.append(max(1, -(-n // block)))
            held = 0
        shard[i] = len(chunks) - 1
        held += n
    return shard, np.array(chunks, np.int32)


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def indexed(clean: DataFrame, n: int) -> tuple[DataFrame, Index]:
    """Every row with its list, written to the shared folder, and the index; at most SAMPLE rows and LISTS facts reach the driver."""
    taken = clean.select("v").orderBy(F.xxhash64("id", "v"), "id", "v").limit(SAMPLE).collect()
    centroids = fit(np.array([r["v"] for r in taken], np.float64), min(LISTS, max(1, n // LIST_ROWS)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(batch.schema.get_field_index("v")), np.float64)
                near = _nearest(rows, centroids)
                far = np.sqrt(((rows - centroids[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*batch.schema.names, "list", "far"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in clean.dtypes)
    placed = materialize(clean.mapInArrow(assign, f"{kinds}, list int, far double"), "lists")
    counts, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():
        counts[r["list"]], radius[r["list"]] = r["n"], r["radius"]
    shard, chunks = shards(counts, DATA_BLOCK)
    return placed, Index(centroids, radius, shard, chunks)


def search_block(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], index: Index, k: int, same: bool, first: bool) -> list[tuple[int, int, int, int]]:
    """(anchor id, goal, row id, score) of the k best rows of a block within each goal's window, ties to the smaller id.

    Rows that cannot be among an anchor's best may be left out. With ``first`` anchors visit the list ``seen`` only, else all others.
    """
    lists, starts = np.unique(rows["list"], return_index=True)  # rows come sorted by list
    ends = [*starts[1:].tolist(), len(rows["list"])]
    reach = float(np.abs(anchors["v"]).max(initial=0)) * float(np.abs(rows["v"]).max(initial=0)) * rows["v"].shape[1]
    kind = np.float64 if reach < EXACT else np.int64  # the float product is exact below 2^53
    asked, data = anchors["v"].astype(kind), rows["v"].astype(kind)
    top, low = (b[:, lists] for b in index.bounds(anchors["v"].astype(np.float64)))
    allowed = (anchors["seen"][:, None] == lists) == first
    least, most = np.maximum(anchors["lo"], anchors["floor"]), anchors["hi"]
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for place in np.argsort(-np.where(allowed, top, -np.inf).max(0), kind="stable"):
        part = slice(starts[place], ends[place])
        live = allowed[:, place] & ((top[:, place, None] >= least) & (low[:, place, None] <= most)).any(1)
        for some in np.array_split(np.flatnonzero(live), max(1, -(-int(live.sum()) // STEP))):
            scores = asked[some] @ data[part].T
            fit_for = (anchors["label"][some, None] == rows["label"][part]) == same
            fit_for &= anchors["id"][some, None] != rows["id"][part]
            for goal in range(least.shape[1]):
                wanted = fit_for & (scores >= least[some, goal, None]) & (scores <= most[some, goal, None])
                for x in np.flatnonzero(wanted.any(1)):
                    a, found = some[x], np.flatnonzero(wanted[x])
                    ids, values = rows["id"][part][found], scores[x, found].astype(np.int64)
                    if (a, goal) in best:
                        ids, values = np.concatenate([best[a, goal][0], ids]), np.concatenate([best[a, goal][1], values])
                    keep = np.lexsort((ids, -values))[:k]
                    best[a, goal] = ids[keep], values[keep]
                    if len(keep) == k:
                        least[a, goal] = max(least[a, goal], values[keep[-1]])
    return [(int(anchors["id"][a]), goal, i, s) for (a, goal), (ids, values) in best.items() for i, s in zip(ids.tolist(), values.tolist(), strict=True)]


def _visit(anchors: DataFrame, placed: DataFrame, index: Index, n_blocks: int, k: int, same: bool, first: bool) -> DataFrame:
    """(anchor, goal int, id, score): candidates of every anchor's goals from the first list, or from all others."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            top, low = index.bounds(matrix(column["v"], np.float64))
            lo, hi, floor, seen = _lists(column["lo"]), _lists(column["hi"]), _lists(column["floor"]), column["seen"].to_numpy()
            wanted = (seen[:, None] == np.arange(top.shape[1])) == first
            reached = np.zeros_like(wanted)
            for goal in range(lo.shape[1]):
                reached |= (top >= np.maximum(lo, floor)[:, goal, None]) & (low <= hi[:, goal, None]) & (lo <= hi)[:, goal, None]
            a, lists = np.nonzero(wanted & reached)
            pairs = np.unique(np.column_stack([a, index.shard[lists]]), axis=0)
            times = index.chunks[pairs[:, 1]]
            pairs = np.repeat(pairs, times, axis=0)
            chunk = np.arange(len(pairs)) - np.repeat(np.cumsum(times) - times, times)
            out = batch.take(pa.array(pairs[:, 0]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pairs[:, 1].astype(np.int32)), pa.array(chunk.astype(np.int32))], [*out.schema.names, "shard", "chunk"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in anchors.dtypes)
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    sent = anchors.mapInArrow(route, f"{kinds}, shard int, chunk int").withColumn("block", block)
    spark = anchors.sparkSession
    facts = spark.createDataFrame([(i, int(s), int(index.chunks[s])) for i, s in enumerate(index.shard)], "list int, shard int, chunks int")
    data = placed.select("id", "label", "v", "list").join(F.broadcast(facts), "list")  # LISTS rows at most
    data = data.withColumn("chunk", F.pmod(F.xxhash64("id", "v"), "chunks").cast("int")).drop("chunks")
    needed = materialize(sent.select("shard", "chunk", "block").distinct(), "needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST else needed.hint("merge")
    keys = ["shard", "chunk", "block"]

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            sides = []
            for side in (queries, rows.sort_by("list")):
                arrays = {n: side.column(n).combine_chunks() for n in side.column_names}
                sides.append({n: _lists(x) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False) for n, x in arrays.items()})
            found = search_block(*sides, index, k, same, first)
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "goal", "id", "score"])

    return sent.groupBy(keys).cogroup(data.join(needed, ["shard", "chunk"]).groupBy(keys)).applyInArrow(search, "anchor long, goal int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each goal, with their place."""
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("place") <= k)


def _reach_goals(anchors: DataFrame, placed: DataFrame, index: Index, n_blocks: int, k: int, same: bool, goals: int) -> DataFrame:
    """(anchor, goal, id, score, place): the k best rows of every goal of anchors (id, label, v, lo, hi)."""

    def first_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                top, low = index.bounds(matrix(batch.column(2), np.float64))
                lo, hi = _lists(batch.column(3)), _lists(batch.column(4))
                able = np.zeros(top.shape, bool)
                for goal in range(goals):
                    able |= (top >= lo[:, goal, None]) & (low <= hi[:, goal, None]) & (lo <= hi)[:, goal, None]
                seen = np.where(able.any(1), np.where(able, top, -np.inf).argmax(1), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen.astype(np.int32))], [*batch.schema.names, "seen"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in anchors.dtypes)
    lowest = F.array(*[F.lit(LOWEST)] * goals)
    ready = materialize(anchors.select("id", "label", "v", "lo", "hi").mapInArrow(first_list, f"{kinds}, seen int").withColumn("floor", lowest), "anchors")
    near = materialize(_best(_visit(ready, placed, index, n_blocks, k, same, True), k), "near")
    kth = near.where(F.col("place") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("kth"))
    floor = F.array(*[F.coalesce(F.try_element_at("kth", F.lit(g)), F.lit(LOWEST)) for g in range(goals)])
    rest = ready.drop("floor").join(kth.withColumnRenamed("anchor", "id"), "id", "left").withColumn("floor", floor).drop("kth")
    far = _visit(rest.select(ready.columns), placed, index, n_blocks, k, same, False)
    return _best(near.drop("place").unionByName(far), k)


def floor_of_percent(whole: str) -> str:
    """SQL of floor(whole / 100) in long arithmetic."""
    return f"({whole} - pmod({whole}, 100)) div 100"


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Columns (anchor_id, positive_id long, rank int, negative_id, positive_score, negative_score long).

    A row's score is the inner product with the anchor of the components floor(scale * x); higher ones come first, ties go to the
    smaller id. An anchor's positives are its first rows of its own label; for each the first ``negatives`` rows of other labels
    are returned whose score is within ``window`` per cent of the positive's, ends included. So a positive below 0 has none.

    Rows whose id, label or vector is null, or whose vector is empty or has null or non-finite components, take no part; a hundred
    times a score must fit a long, vectors meet only vectors of their own size. Of several anchor rows with one id the one with the smallest
    vector and label asks; rows that share an anchor's id are no candidates of it. Repeated rows are rows of their own. An empty
    table gives an empty result. Other columns are not read. The result is exact; only the lists depend on the sample of SAMPLE rows.
    """
    spark = vectors.sparkSession
    known = F.col(id_column).cast("long").alias("id"), label.alias("label"), quantized(vector_column, scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q")
    clean = vectors.select(*known).where("id is not null and label is not null and v is not null and size(v) > 0")
    seen = clean.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.count_if("q").alias("anchors"))
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], names)
    for r in sorted(seen.where("anchors > 0").collect()):
        placed, index = indexed(clean.where(F.size("v") == r["dims"]), r["n"])
        n_blocks = -(-r["anchors"] // ANCHOR_BLOCK)
        asking = placed.where("q").groupBy("id").agg(F.min(F.struct("v", "label")).alias("x")).select("id", "x.label", "x.v")
        everything = asking.withColumns({"lo": F.array(F.lit(LOWEST)), "hi": F.array(F.lit(HIGHEST))})
        near = materialize(_reach_goals(everything, placed, index, n_blocks, positives, True, 1), "positives")
        of = near.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("p"))
        # the window in whole numbers; a missing positive has an empty one
        part = lambda w, i: f"({w} * try_element_at(p, {i + 1}))"
        lo = F.array(*[F.coalesce(-F.expr(floor_of_percent(part(-window[0], i))), F.lit(1).cast("long")) for i in range(positives)])
        hi = F.array(*[F.coalesce(F.expr(floor_of_percent(part(window[1], i))), F.lit(0).cast("long")) for i in range(positives)])
        goals = asking.join(of.withColumnRenamed("anchor", "id"), "id").withColumns({"lo": lo, "hi": hi}).drop("p")
        hard = _reach_goals(goals, placed, index, n_blocks, negatives, False, positives)
        pairs = near.select("anchor", (F.col("place") - 1).alias("goal"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = hard.join(pairs, ["anchor", "goal"])
        out = out.unionByName(joined.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out
