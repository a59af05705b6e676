"""Exact medians by selection: counts in bins narrow the range that holds the middle until few values are left.

No task holds the values of a group: a pass counts by bin, keeps the bin of the middle rank, and the next pass divides it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlight.operators.blocks import lookup
from leadlight.sources.storage import stored

#: Bins of a pass, values that are left before they are sorted, values of a group up to which Spark's own median serves.
BINS, FEW, DIRECT = 256, 1024, 1 << 22


def medians(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median) of cells (keys, value double); null values are left out, and keys without values.

    Of an even number of values it is the mean of the two in the middle. Up to DIRECT values of a key are left to Spark's exact
    median, which counts the distinct values of a key in one task; beyond that the two middle ranks are selected by passes.
    """
    names = [f"k{i}" for i in range(len(keys))]
    cells = cells.where("value is not null").select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("value").cast("double").alias("value"))
    sizes = cells.groupBy(names).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    heavy = stored(sizes.where(F.col("n") > DIRECT), "heavy")
    back = lambda df: df.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "median")
    if heavy.isEmpty():
        return back(cells.groupBy(names).agg(F.median("value").alias("median")))
    same = [F.col(n).eqNullSafe(F.col(f"h_{n}")) for n in names]
    marked = heavy.select(*[F.col(n).alias(f"h_{n}") for n in names])
    light = cells.join(F.broadcast(marked) if heavy.count() <= 10_000 else marked, same, "left_anti")
    return back(light.groupBy(names).agg(F.median("value").alias("median"))).unionByName(back(_selected(cells, heavy, names)))


def _selected(cells: DataFrame, heavy: DataFrame, names: list[str]) -> DataFrame:
    """(names, median) of the keys in ``heavy`` (names, n, lo, hi)."""
    key = F.struct(*names)  # a struct has no null, so it joins
    of = F.inline(F.array(*[F.struct(F.floor(r).cast("long").alias("rank"), F.lit(i).alias("which")) for i, r in enumerate(((F.col("n") - 1) / 2, F.col("n") / 2))]))
    targets = heavy.select(key.alias("key"), "n", "lo", "hi", of)
    values, found = cells.select(key.alias("key"), "value"), []
    while True:
        # a range of one value is settled whatever its number of rows
        targets = stored(targets, "targets")
        found.append(targets.where("lo = hi").select("key", "which", F.col("lo").alias("value")))
        few = targets.where((F.col("lo") < F.col("hi")) & (F.col("n") <= FEW))
        near = lookup(values, few, ["key"]).where("value between lo and hi")
        found.append(near.groupBy("key", "which").agg(F.sort_array(F.collect_list("value")).alias("v"), F.first("rank").alias("rank")).select("key", "which", F.col("v")[F.col("rank").cast("int")].alias("value")))
        many = targets.where((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if many.isEmpty():
            break
        inside = lookup(values, many, ["key"]).where("value between lo and hi")
        # half the range at a time, as the whole may be beyond a double
        bin_ = F.least(F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        counts = inside.groupBy("key", "which", "rank", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        before = F.sum("c").over(W.partitionBy("key", "which").orderBy("bin")) - F.col("c")
        targets = counts.withColumn("before", before).where("rank >= before and rank < before + c").select("key", F.col("c").alias("n"), "lo", "hi", (F.col("rank") - F.col("before")).alias("rank"), "which")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    both = stored(out, "middles")
    return both.groupBy("key").agg((F.min("value") / 2 + F.max("value") / 2).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select("key.*", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("mean")).alias("median"))
