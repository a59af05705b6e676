"""A clustering run: assignments with representatives, a summary of each cluster, and counts of the running job beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadlight.functions.rules import col
from leadlight.operators.blocks import lookup
from leadlight.operators.cluster import CONTEXT, butina_clusters, group_summary, medoids
from leadlight.sources.storage import stored, write_text

#: Sizes of the largest clusters that the metadata lists.
LARGEST = 10


def assigned(library: DataFrame, clusters: DataFrame, representatives: DataFrame) -> DataFrame:
    """The library with Cluster_ID, Cluster_Size, Cluster_Representative_ID and Cluster_MedoidMeanSim; null without a cluster.

    clusters: (row, Cluster_ID), of which null is none.
    """
    known = clusters.where("Cluster_ID is not null").select("row", "Cluster_ID")
    sizes = known.groupBy("Cluster_ID").agg(F.count("*").alias("Cluster_Size"))
    facts = sizes.join(representatives.select("Cluster_ID", "Cluster_Representative_ID", "Cluster_MedoidMeanSim"), "Cluster_ID")
    return library.join(lookup(known, facts, ["Cluster_ID"]), "row", "left")


def summary(assignments: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """(Cluster_ID, Count, Representative, Example_Compounds, mean and median of each context column) of every cluster."""
    facts = assignments.where("Cluster_ID is not null").groupBy("Cluster_ID").agg(F.first("Cluster_Representative_ID").alias("Representative"))
    out = group_summary(assignments, "Cluster_ID", "Compound_ID", "SMILES", "row", context).join(facts, "Cluster_ID")
    stats = [c for c in out.columns if c.endswith(("_mean", "_median"))]
    return out.select("Cluster_ID", F.col("n").alias("Count"), "Representative", F.col("example_ids").alias("Example_Compounds"), *[col(c) for c in stats])


def counts_of(assignments: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The assignments, written, and what the writing job counted: rows, those clustered, those whose structure is invalid.

    The counts come from the job itself, not from another scan.
    """
    seen = Observation("clusters")
    watched = assignments.observe(seen, F.count("*").alias("rows_in_input"), F.count("Cluster_ID").alias("molecules_clustered"), F.count_if(F.col("fp").isNull()).alias("invalid_smiles"))
    written = stored(watched, "assignments")
    return written, {k: int(v) for k, v in seen.get.items()}


def cluster_run(library: DataFrame, n_bits: int, folder: str, threshold: float = 0.7, name: str = "tanimoto", context: tuple[str, ...] = CONTEXT) -> dict[str, object]:
    """Clusters of a library (row, Compound_ID, SMILES, fp and context columns) below ``folder``; returns the metadata.

    assignments and summary are Parquet folders, cluster_metadata.json has the parameters, the counts, the number of clusters and
    the sizes of the largest.
    """
    clusters = stored(butina_clusters(library, n_bits, threshold, name).select("row", "Cluster_ID"), "clusters")
    table, counts = counts_of(assigned(library, clusters, medoids(clusters, library, n_bits, name)))
    table.drop("fp").write.mode("overwrite").parquet(f"{folder}/assignments")
    seen = Observation("summary")
    summary(table, context).observe(seen, F.count("*").alias("count")).write.mode("overwrite").parquet(f"{folder}/summary")
    largest = library.sparkSession.read.parquet(f"{folder}/summary").orderBy(F.desc("Count"), "Cluster_ID").limit(LARGEST).collect()
    facts = {"parameters": {"similarity": threshold, "metric": name, "nbits": n_bits}, "counts": counts, "clusters": {"count": int(seen.get["count"]), "sizes_top10": [r["Count"] for r in largest]}}
    write_text(library.sparkSession, f"{folder}/cluster_metadata.json", json.dumps(facts, indent=2) + "\n")
    return facts


def search_counts(queries: DataFrame, hits: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """The hits of a batch search, written, and its counts: queries, those that failed by name (at most 1000 names), and hits."""
    seen = Observation("hits")
    written = stored(hits.observe(seen, F.count("*").alias("hits")), "hits")
    asked = queries.agg(F.count("*").alias("n"), F.count("fp").alias("valid")).first()
    failed = queries.where("fp is null").select(F.col("Compound_ID").cast("string")).orderBy("Compound_ID").limit(1000).collect()
    return written, {"queries": asked["n"], "valid": asked["valid"], "failed": [r[0] for r in failed], "hits": int(seen.get["hits"])}
