"""Synthetic accessibility from fragment counts: a lookup join, penalties for size and complexity, and a scale from 1 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.operators.blocks import lookup

#: Score of a fragment that the table does not know, and the ends of the raw scale.
UNKNOWN, LOWEST, HIGHEST = -4.0, -4.0, 2.5


def sa_scores(df: DataFrame, fragments: DataFrame, key: str = "row", counts: str = "Morgan_Counts", atoms: str = "HeavyAtoms", centres: str = "Stereocenters", spiro: str = "SpiroAtoms", bridgeheads: str = "BridgeheadAtoms", macrocycles: str = "Macrocycles") -> DataFrame:
    """The table with SA_Score (2 decimals), null without fragments.

    fragments: (fragment, score). The mean score of a row's fragments, weighted by count, less penalties for size, stereo,
    spiro and bridgehead atoms and macrocycles, plus half the logarithm of atoms per distinct fragment where that is above
    one. Rows are exploded and look their fragments up: the table is broadcast up to a size that is checked, else Spark splits
    what many rows have. ``key`` must be unique.
    """
    cells = df.select(col(key).alias("__key"), F.explode(col(counts)).alias("fragment", "n"))
    scored = lookup(cells, fragments.select("fragment", "score"), ["fragment"], "left")
    mean = scored.groupBy("__key").agg((F.sum(F.coalesce("score", F.lit(UNKNOWN)) * F.col("n")) / F.sum("n")).alias("__mean"), F.count("*").alias("__kinds"))
    n, log = col(atoms).cast("double"), lambda c: F.log10(F.coalesce(col(c), F.lit(0)) + 1.0)
    present = [log(c) for c in (centres, spiro, bridgeheads) if c in df.columns]
    large = F.when(col(macrocycles) > 0, F.log10(F.lit(2.0))).otherwise(0.0) if macrocycles in df.columns else F.lit(0.0)
    raw = F.col("__mean") - (F.pow(n, F.lit(1.005)) - n) - sum(present, large) + F.when(n > F.col("__kinds"), 0.5 * F.ln(n / F.col("__kinds"))).otherwise(0.0)
    scale = 11 - (raw - LOWEST + 1) / (HIGHEST - LOWEST) * 9
    smooth = F.when(scale > 8, 8 + F.ln(scale + 1 - 9)).otherwise(scale)
    out = df.join(mean, col(key) == F.col("__key"), "left")
    return out.withColumn("SA_Score", F.round(F.least(F.greatest(smooth, F.lit(1.0)), F.lit(10.0)), 2)).drop("__key", "__mean", "__kinds")
