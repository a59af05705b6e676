"""The member of each cluster with the highest mean similarity to the others, without comparing all with all.

Some members are references: their similarities to all members are computed, hence their means. The members are counted by
cells of their distances to the references; by the triangle inequality these counts bound every member's mean from above, and
who stays below the best mean known is out. After a few rounds those left are compared with all members, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.functions.similarity import metric
from leadlight.operators.blocks import dealt
from leadlight.operators.ranges import distances, matrix
from leadlight.sources.storage import dropped, stored

#: References of a cluster in a round, rounds, bins of the distances to a reference, members from which on a cluster has bounds, rows of a block.
REFERENCES, TURNS, BINS, LARGE, CROWD = 3, 2, 32, 256, 2048
#: Means are compared as rounded to so many digits, so that equal members are equal whatever the order of a sum.
DIGITS = 12


class Vectors:
    """Similarity 1 / (1 + Euclidean distance)."""

    kind, bounded = "array<double>", True
    matrix = staticmethod(matrix)
    distances = staticmethod(distances)

    @staticmethod
    def similar(distance: np.ndarray | F.Column) -> np.ndarray | F.Column:
        return 1 / (1 + distance)

    symmetric = True

    @staticmethod
    def found(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) of rows of x and y within ``radius``; near it the differences decide."""
        i, j = np.nonzero(distances(x, y) <= radius * (1 + 1e-9) + 1e-9)
        far = np.zeros(len(i))
        for at in range(0, len(i), 1 << 14):
            part = slice(at, at + (1 << 14))
            far[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(1))
        kept = far <= radius
        return i[kept], j[kept], far[kept]


class Bits:
    """A metric of packed fingerprints; only for tanimoto is 1 - similarity a distance that can bound others."""

    kind = "array<bigint>"

    def __init__(self, name: str, n_bits: int) -> None:
        metric(name)
        self.name, self.n_bits, self.bounded = name.lower(), n_bits, name.lower() == "tanimoto"

    @staticmethod
    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)

    @property
    def symmetric(self) -> bool:
        return self.name != "asymmetric"

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 1 - self.similarities(x, y)

    def found(self, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, similarity) of rows of x and y from ``least`` on."""
        if self.name != "tanimoto" or least <= 0:
            near = self.similarities(x, y)
            i, j = np.nonzero(near >= least)
            return i, j, near[i, j]
        a, b = (np.bitwise_count(m).sum(1).astype(np.float32) for m in (x, y))
        both = np.bitwise_count(x[:, 0, None] & y[:, 0]).astype(np.uint16)
        for w in range(1, x.shape[1]):
            both += np.bitwise_count(x[:, w, None] & y[:, w])
        share = np.float32(least / (1 + least) * (1 - 1e-4))  # of the bits of each; those few that reach it are divided
        i, j = np.nonzero(both >= np.maximum((a * share)[:, None] + b * share, 1))
        c = both[i, j].astype(np.float64)
        near = c / (a[i].astype(np.float64) + b[j] - c)
        kept = near >= least
        return i[kept], j[kept], near[kept]

    def similarities(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By a formula of the bits of each and of both; a quotient by 0 is 0."""
        a, b = (np.bitwise_count(m).sum(1).astype(np.float64) for m in (x, y))
        both = np.zeros((len(x), len(y)))
        for w in range(x.shape[1]):
            both += np.bitwise_count(x[:, w, None] & y[:, w])
        a, b, c = a[:, None], b[None, :], both
        ratio = lambda top, bottom: np.divide(top, bottom, out=np.zeros(np.broadcast_shapes(np.shape(top), np.shape(bottom))), where=bottom != 0)
        forms = {
            "tanimoto": lambda: ratio(c, a + b - c),
            "dice": lambda: ratio(2 * c, a + b),
            "cosine": lambda: ratio(c, np.sqrt(a * b)),
            "sokal": lambda: (self.n_bits - a - b + 2 * c) / self.n_bits,
            "russel": lambda: c / self.n_bits,
            "kulczynski": lambda: (ratio(c, a * np.ones_like(b)) + ratio(c, b * np.ones_like(a))) / 2 * ((a > 0) & (b > 0)),
            "mcconnaughey": lambda: ratio(c * c - (a - c) * (b - c), a * b),
            "asymmetric": lambda: ratio(c, a * np.ones_like(b)),
            "braun_blanquet": lambda: ratio(c, np.maximum(a, b)),
        }
        return forms[self.name]()

    @staticmethod
    def similar(distance: np.ndarray | F.Column) -> np.ndarray | F.Column:
        return 1 - distance


def best_members(members: DataFrame, measure: Vectors | Bits) -> DataFrame:
    """(Cluster_ID, row, mean) of members (Cluster_ID, row, x): the highest mean similarity to the others, the first row on ties.

    A row alone has a mean of 1. No task holds more than two blocks of a cluster; small clusters share tasks.
    """
    cluster = dict(members.dtypes)["Cluster_ID"]
    sizes = members.groupBy("Cluster_ID").agg(F.count("*").alias("size"))
    rows = stored(members.select("Cluster_ID", "row", "x").join(sizes, "Cluster_ID"), "members")
    alone = rows.where("size = 1").select("Cluster_ID", "row", F.lit(1.0).alias("mean"))
    many = rows.where("size > 1")
    left = many.withColumn("candidate", F.lit(True))
    if measure.bounded and not many.where(F.col("size") > LARGE).isEmpty():
        left = _screened(many, measure)
    small = many.agg(F.count_if(F.col("size") <= LARGE)).first()[0] or 0
    packs = max(1, -(-small // CROWD))
    unit = F.when(F.col("size") <= LARGE, F.pmod(F.xxhash64("Cluster_ID"), F.lit(packs)) - packs).otherwise(F.lit(0))
    own = F.when(F.col("size") > LARGE, F.col("Cluster_ID"))
    # a pack of small clusters has no ``own``, so it is never cut; it holds about CROWD rows
    dealt_rows = dealt(left.withColumns({"unit": unit, "own": own}).drop("size"), ["unit", "own"], F.col("row"), CROWD)

    def total(block: pa.Table) -> pa.Table:
        """Sums of the similarities of candidates to the members of the other chunk (or their own)."""
        one, other = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        row, chunk, candidate = (block.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("row", "chunk", "candidate"))
        of = block.column("Cluster_ID").combine_chunks().dictionary_encode()
        x, code, sums, asked = measure.matrix(block.column("x")), of.indices.to_numpy(), np.zeros(len(row)), candidate.astype(bool)
        for c in range(len(of.dictionary)):
            mine = np.flatnonzero(code == c)
            for a, b in {(one, other), (other, one)}:
                to = mine[chunk[mine] == b]
                some = mine[(chunk[mine] == a) & asked[mine]]
                for start in range(0, len(some), 256):
                    part = some[start : start + 256]
                    near = measure.similar(measure.distances(x[part], x[to]))
                    sums[part] += np.where(row[part, None] == row[to], 0, near).sum(1)
        return pa.table([block.column("Cluster_ID").filter(pa.array(asked)), pa.array(row[asked]), pa.array(sums[asked])], names=["Cluster_ID", "row", "part"])

    parts = dealt_rows.groupBy("unit", "own", "i", "j").applyInArrow(total, f"Cluster_ID {cluster}, row long, part double")
    whole = parts.groupBy("Cluster_ID", "row").agg(F.sum("part").alias("sum")).join(sizes, "Cluster_ID")
    means = whole.select("Cluster_ID", "row", F.round(F.col("sum") / (F.col("size") - 1), DIGITS).alias("mean")).unionByName(alone)
    best = means.groupBy("Cluster_ID").agg(F.max(F.struct("mean", (-F.col("row")).alias("first"))).alias("m"))
    return best.select("Cluster_ID", (-F.col("m.first")).alias("row"), F.col("m.mean").alias("mean"))


def _beside(rows: DataFrame, facts: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on blocks of a cluster's rows, each with the one row that ``facts`` has of the cluster; facts are repeated by block only."""
    parts = lambda size: F.ceil(F.col(size) / CROWD).cast("int")
    blocks = rows.withColumn("part", F.pmod(F.xxhash64("row"), parts("size")).cast("int"))
    sizes = rows.select("Cluster_ID", F.col("size").alias("members")).distinct()
    spread = facts.join(sizes, "Cluster_ID").withColumn("part", F.explode(F.sequence(F.lit(0), parts("members") - 1)))
    spread = spread.toDF(*[f"f_{c}" for c in spread.columns]).toDF(*spread.columns)  # new columns, even if facts come from the rows
    return blocks.groupBy("Cluster_ID", "part").cogroup(spread.groupBy("Cluster_ID", "part")).applyInArrow(run, schema)


def _screened(many: DataFrame, measure: Vectors | Bits) -> DataFrame:
    """The members with ``candidate``: false if a bound rules them out. Clusters up to LARGE members are all candidates."""
    cluster = dict(many.dtypes)["Cluster_ID"]
    columns = f"Cluster_ID {cluster}, row long, x {measure.kind}, size long, bound double, candidate boolean"
    known = many.where(F.col("size") > LARGE).withColumns({"bound": F.lit(float("inf")), "candidate": F.lit(True)})

    def measured(rows: pa.Table, facts: pa.Table) -> pa.Table:
        names = [n for n in rows.column_names if n != "part"]
        if not rows.num_rows:
            return pa.table([rows.column(n) for n in names] + [pa.array([], pa.list_(pa.float64()))], names=[*names, "far"])
        far = measure.distances(measure.matrix(rows.column("x")), measure.matrix(facts.column("refs").combine_chunks()[0].values))
        ends = pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1])
        return pa.table([*[rows.column(n) for n in names], pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], names=[*names, "far"])

    for _ in range(TURNS):
        # the first references are drawn by hash, later ones have the highest bounds left
        order = W.partitionBy("Cluster_ID").orderBy(F.desc("bound"), F.xxhash64("row"), "row")
        drawn = known.where("candidate").withColumn("n", F.row_number().over(order)).where(F.col("n") <= REFERENCES)
        references = stored(drawn.groupBy("Cluster_ID").agg(F.collect_list("x").alias("refs")), "references")
        seen = stored(_beside(known.select("Cluster_ID", "row", "x", "size", "bound", "candidate"), references, measured, f"{columns}, far array<double>"), "seen")
        sums = seen.select("Cluster_ID", "size", F.posexplode("far").alias("k", "d")).groupBy("Cluster_ID", "size", "k").agg(F.sum(measure.similar(F.col("d"))).alias("s"), F.max("d").alias("top"))
        # a reference is similar to itself by 1, or by 0 if it has no bits; so its mean is this or more
        facts = sums.groupBy("Cluster_ID").agg(F.max((F.col("s") - 1) / (F.col("size") - 1)).alias("floor"), (F.max("top") / BINS + 1e-12).alias("width"))
        facts = stored(facts, "facts")
        place = F.transform("far", lambda d: F.least(F.floor(d / F.col("width")), F.lit(BINS - 1)).cast("int"))
        cells = seen.select("Cluster_ID", "far").join(facts, "Cluster_ID").groupBy("Cluster_ID", place.alias("cell")).agg(F.count("*").alias("n"))
        shapes = cells.groupBy("Cluster_ID").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts"))  # BINS ** REFERENCES at most
        known = stored(_beside(seen, shapes.join(facts, "Cluster_ID"), lambda rows, facts: _bounded(rows, facts, measure), columns), "bounded")
        dropped(seen)
    small = many.where(F.col("size") <= LARGE).withColumn("candidate", F.lit(True))
    return known.select("Cluster_ID", "row", "x", "size", "candidate").unionByName(small.select("Cluster_ID", "row", "x", "size", "candidate"))


def _bounded(rows: pa.Table, facts: pa.Table, measure: Vectors | Bits) -> pa.Table:
    """The rows with their bounds lowered to what the cells allow, and without candidates that stay below the floor.

    A cell holds the members whose distances to all references fall into the same bins; a row is at least as far from them
    as its own distance to any one reference is from the bin.
    """
    bound, candidate = rows.column("bound").to_numpy().copy(), rows.column("candidate").to_numpy(zero_copy_only=False).astype(bool)
    if rows.num_rows:
        fact = {n: facts.column(n).combine_chunks()[0] for n in ("cells", "counts", "floor", "width")}
        width, count = fact["width"].as_py(), np.array(fact["counts"].as_py(), float)
        cells = np.array(fact["cells"].as_py()).reshape(len(count), -1)
        low, high = cells * width, np.where(cells == BINS - 1, np.inf, (cells + 1) * width)
        far = matrix(rows.column("far"))
        for start in range(0, len(far), 32):
            part = far[start : start + 32]
            gap = np.zeros((len(part), len(count)))
            for k in range(far.shape[1]):
                d = part[:, k, None]
                np.maximum(gap, np.maximum(low[:, k] - d, d - high[:, k]), out=gap)
            # without the row itself, which lies in a cell that it touches
            top = (measure.similar(gap) @ count - 1) / (rows.column("size")[0].as_py() - 1) + 1e-9
            bound[start : start + 32] = np.minimum(bound[start : start + 32], top)
        candidate &= bound >= fact["floor"].as_py() - 1e-9
    return pa.table([*[rows.column(n) for n in ("Cluster_ID", "row", "x", "size")], pa.array(bound), pa.array(candidate)], names=["Cluster_ID", "row", "x", "size", "bound", "candidate"])
