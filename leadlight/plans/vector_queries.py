"""Queries over vectors: pairs within a distance, clusters and medoids of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.operators.cluster import butina_vectors, medoids, vector_medoids
from leadlight.operators.ranges import range_pairs
from leadlight.plans.adapters import FP_SQL, N_BITS, fingerprints
from leadlight.plans.clusters import assigned, counts_of, summary
from leadlight.plans.registry import register
from leadlight.sources.storage import stored

#: Similarity 1 / (1 + distance) from which on vectors are neighbours.
SIMILAR = 0.47

_PAIRS = f"""v as (select vec_id as r, label, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings),
d as materialized (select a.r as a, b.r as b, a.label = b.label as same, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as far from v a join v b on a.r < b.r),
e as materialized (select a, b, far from d where far <= 1 / {SIMILAR}::double - 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "row")


@register("vector_range_pairs", f"with {_PAIRS} select a as a_row, b as b_row, round(far, 9) as distance from e")
def vector_range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors within a Euclidean distance."""
    return range_pairs(vectors(spark, sf_dir), 1 / SIMILAR - 1).withColumn("distance", F.round("distance", 9))


@register("cluster_butina_vectors", f"""with recursive {_PAIRS},
sides as (select a, b from e union all select b, a from e),
place as materialized (select r, row_number() over (order by coalesce(n, 0) desc, r) as p from v left join (select a, count(*) as n from sides group by a) on a = r),
near as materialized (select x.p as p, list(y.p) as before from sides join place x on x.r = sides.a join place y on y.r = sides.b where y.p < x.p group by x.p),
greedy(p, starts) as (
  select 0::bigint, []::bigint[]
  union all select g.p + 1, case when n.before is null or not list_has_any(n.before, g.starts) then list_append(g.starts, g.p + 1) else g.starts end
  from greedy g left join near n on n.p = g.p + 1 where g.p < (select count(*) from place)),
starts as (select starts from greedy order by p desc limit 1),
center as (select place.r, place.p, case when list_contains(starts, place.p) then place.p else list_min(list_filter(before, lambda q: list_contains(starts, q))) end as c from place left join near on near.p = place.p, starts),
sizes as (select c, count(*) as n, cast(row_number() over (order by count(*) desc, c) as int) as id from center group by c)
select r as "row", id as "Cluster_ID", n as "Cluster_Size" from center join sizes on sizes.c = center.c""")
def cluster_butina_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors within a Euclidean distance; the greedy rule is one row after another in SQL."""
    return butina_vectors(vectors(spark, sf_dir), SIMILAR)


@register("cluster_vector_medoids", f"""with {_PAIRS},
s as (select a as r, 1 / (1 + far) as s from d where same union all select b, 1 / (1 + far) from d where same),
m as (select v.label, v.r, coalesce(round(avg(s), 12), 1.0) as mean from v left join s on s.r = v.r group by all)
select label as "Cluster_ID", r as "row", round(mean, 9) as "Cluster_MedoidMeanSim" from m qualify row_number() over (partition by label order by mean desc, r) = 1""")
def cluster_vector_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most central vector of every label."""
    table = vectors(spark, sf_dir)
    found = vector_medoids(table.select("row", F.col("label").alias("Cluster_ID")), table)
    return found.withColumn("Cluster_MedoidMeanSim", F.round("Cluster_MedoidMeanSim", 9))


@register("cluster_summary", f"""with {FP_SQL},
x as (select fp.*, cast(embedding[63] as double) as "LogP", case when vec_id % 11 = 0 then null else cast(embedding[64] as double) end as "QED" from fp join embeddings on vec_id = "row"),
p as (select a.label as c, a."row" as r, a.Compound_ID as id, round(avg(cast(bit_count(a.f & b.f) as double) / bit_count(a.f | b.f)), 12) as mean from fp a join fp b on a.label = b.label and a."row" <> b."row" group by all),
m as (select c, id from p qualify row_number() over (partition by c order by mean desc, r) = 1)
select cast(label as int) as "Cluster_ID", count(*) as "Count", any_value(m.id) as "Representative", list_aggregate(list_slice(list(Compound_ID order by "row"), 1, 5), 'string_agg', ', ') as "Example_Compounds",
  round(avg("LogP"), 9) as "LogP_mean", round(median("LogP"), 9) as "LogP_median", round(avg("QED"), 9) as "QED_mean", round(median("QED"), 9) as "QED_median" from x join m on m.c = label group by 1""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label as a cluster: its size, representative, first members, and context columns."""
    part = F.element_at
    context = vectors(spark, sf_dir).select("row", part("embedding", 63).cast("double").alias("LogP"), F.when(F.col("row") % 11 != 0, part("embedding", 64).cast("double")).alias("QED"))
    library = stored(fingerprints(spark, sf_dir).join(context, "row"), "library")
    clusters = library.select("row", F.col("label").alias("Cluster_ID"))
    table, _ = counts_of(assigned(library.drop("label"), clusters, medoids(clusters, library, N_BITS)))
    return summary(table, ("LogP", "QED")).select("Cluster_ID", "Count", "Representative", "Example_Compounds", *[F.round(f"{c}_{k}", 9).alias(f"{c}_{k}") for c in ("LogP", "QED") for k in ("mean", "median")])
