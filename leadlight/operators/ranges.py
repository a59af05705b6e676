"""All pairs of vectors within a Euclidean distance, exactly.

A few vectors far from each other are pivots. Every vector is at home in the ring of its nearest pivot into which its distance
to that pivot falls, and each ring keeps the least and largest distance of its vectors to every pivot. By the triangle
inequality a vector can be near one of a ring only if its own distance to every pivot is within the radius of the ring's
range; it is a guest of such rings, and of no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.operators.blocks import blocked
from leadlight.sources.storage import stored

#: Rows (by hash) among which pivots are chosen, pivots and rings of each at most, rows of a ring that meet in one task.
SAMPLE, PIVOTS, RINGS, CROWD = 4096, 24, 16, 8192


def whole(vector: str) -> F.Column:
    """True for a vector that has components, all of them finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b; what a product of matrices can't tell is computed from the differences."""
    sizes = (a**2).sum(1)[:, None] + (b**2).sum(1)
    square = np.maximum(sizes - 2 * a @ b.T, 0)
    x, y = np.nonzero(square < 1e-4 * sizes)
    for start in range(0, len(x), 1 << 16):
        p, q = x[start : start + (1 << 16)], y[start : start + (1 << 16)]
        square[p, q] = ((a[p] - b[q]) ** 2).sum(1)
    return np.sqrt(square)


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
        chosen.append(int(far.argmax()))
    return sample[chosen]


def range_pairs(vectors: DataFrame, radius: float, row: str = "row", vector: str = "embedding") -> DataFrame:
    """(a_row, b_row, distance) with a_row < b_row of all pairs within ``radius``, ends included.

    Vectors that are null, empty or not finite are near nothing; vectors are compared with those of their own size; ``row`` is
    unique. At most SAMPLE vectors and PIVOTS * RINGS ranges come to the driver; the result does not depend on them.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(row).cast("long").alias("row"), F.col(vector).alias("v")).where(F.col("row").isNotNull() & whole("v"))
    out = spark.createDataFrame([], "a_row long, b_row long, distance double")
    for r in clean.groupBy(F.size("v").alias("n")).count().where("count > 1").orderBy("n").collect():
        out = out.unionByName(_pairs_of_size(clean.where(F.size("v") == r["n"]), radius, r["count"]))
    return out


def placed_rows(clean: DataFrame, radius: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(row, v, ring, home): every vector where it is at home and where it is a guest, in rings before its own only.

    There are about as many rings as the rows make blocks of CROWD, so where the radius is so large that none is left out, a row is
    sent no more often than if all blocks met. The table of distances that this reads is returned, too.
    """
    kind, wanted = dict(clean.dtypes)["v"], max(1, n // CROWD)
    some = int(np.clip(np.ceil(np.sqrt(wanted)), 1, PIVOTS))
    rings = int(np.clip(np.ceil(wanted / some), 1, RINGS))
    taken = clean.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
    chosen = pivots(np.array([r["v"] for r in taken], np.float64), some)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = distances(matrix(batch.column(1)), chosen)
                ends = pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1)), pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], ["row", "v", "pivot", "near", "far"])

    measured = stored(clean.mapInArrow(measure, f"row long, v {kind}, pivot int, near double, far array<double>"), "measured")
    width = max(radius / 2, (measured.agg(F.max("near")).first()[0] or 0) / rings, 1e-300)
    ring = (F.col("pivot") * rings + F.least(F.floor(F.col("near") / width), F.lit(rings - 1))).cast("int")
    ends = [f(F.col("far")[i]) for f in (F.min, F.max) for i in range(len(chosen))]
    facts = sorted(measured.groupBy(ring.alias("ring")).agg(F.array(*ends).alias("ends")).collect())
    numbers, span = np.array([r["ring"] for r in facts], np.int32), np.array([r["ends"] for r in facts])
    reach = radius * (1 + 1e-9) + 1e-9
    low, high = span[:, : len(chosen)] - reach, span[:, len(chosen) :] + reach

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                far, own = matrix(part.column(2)), part.column(3).to_numpy()
                able = numbers <= own[:, None]
                for p in range(far.shape[1]):
                    able &= (far[:, p, None] >= low[:, p]) & (far[:, p, None] <= high[:, p])
                at, to = np.nonzero(able)
                sent = part.select([0, 1]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(numbers[to]), pa.array(numbers[to] == own[at])], ["row", "v", "ring", "home"])

    return measured.select("row", "v", "far", ring.alias("own")).mapInArrow(place, f"row long, v {kind}, ring int, home boolean"), measured


def _meetings(placed: DataFrame, n: int) -> DataFrame:
    """The rows with i, j and chunk at all meetings of their ring: its own chunks with each other and with those of its guests.

    Guests don't meet guests. Where that leaves out less than half of all pairs, all rows are at home in one ring instead.
    """
    rings = placed.groupBy("ring").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("guests"))
    pairs = rings.agg(F.sum(F.col("own").cast("double") * ((F.col("own") - 1) / 2 + F.col("guests")))).first()[0] or 0
    if pairs > n * (n - 1) / 4:
        return blocked(placed.where("home").withColumn("ring", F.lit(0)), "row", CROWD)
    part = lambda c: F.ceil(F.col(c) / CROWD).cast("int")
    table = placed.join(F.broadcast(rings.select("ring", part("own").alias("o"), part("guests").alias("g"))), "ring")  # PIVOTS * RINGS rows at most
    cut = table.withColumn("chunk", F.when(F.col("home"), F.pmod(F.xxhash64("row"), "o")).otherwise(F.col("o") + F.pmod(F.xxhash64("row"), "g")).cast("int"))
    last = F.when(F.col("home"), F.col("o") + F.col("g")).otherwise(F.col("o")) - 1
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other", "o", "g")


def _pairs_of_size(clean: DataFrame, radius: float, n: int) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = pa.Table.from_batches(list(batches))
        row, chunk = (ring.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("row", "chunk"))
        v, one, other = matrix(ring.column("v")), ring.column("i")[0].as_py(), ring.column("j")[0].as_py()
        first, second = np.flatnonzero(chunk == one), np.flatnonzero(chunk == other)
        for start in range(0, len(first), 256):
            some = first[start : start + 256]
            x, y = np.nonzero(distances(v[some], v[second]) <= radius * (1 + 1e-9) + 1e-9)
            p, q = some[x], second[y]
            if one == other:
                p, q = p[row[p] < row[q]], q[row[p] < row[q]]
            far = np.zeros(len(p))
            for at in range(0, len(p), 1 << 14):
                part = slice(at, at + (1 << 14))
                far[part] = np.sqrt(((v[p[part]] - v[q[part]]) ** 2).sum(1))
            a, b = row[p[far <= radius]], row[q[far <= radius]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far[far <= radius])], ["a_row", "b_row", "distance"])

    placed, _ = placed_rows(clean, radius, n)
    return _meetings(placed, n).groupBy("ring", "i", "j").applyInArrow(compare, "a_row long, b_row long, distance double")
