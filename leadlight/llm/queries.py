"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlight.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    from leadlight.llm.bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as motion-JPEG, read back, and cut into shots."""
    from leadlight.llm.media import media_columns

    stored = media_columns(table(spark, sf_dir, "documents"))
    shot = F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"].cast("string"), (c["first_frame"] + c["frames"]).cast("string")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("shots="), F.size("clips").cast("string"), F.lit(" frames="), F.array_join(shot, ",")).alias("feature"),
    )


def media_clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each timed clip of every document stored as motion-JPEG."""
    from leadlight.llm.media import clip_rows, media_columns

    return clip_rows(media_columns(table(spark, sf_dir, "documents")).select("doc_id", "media"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document and whether they pass 1024."""
    from leadlight.llm.token_counts import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector among all."""
    from leadlight.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP4_SQL = """
with clean as (
  select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from clean q join clean c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 10
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from leadlight.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    from leadlight.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"),
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based language-model scores of every document; a fifth of them is not learned from."""
    from leadlight.llm.brown_lm import score
    from leadlight.llm.common import in_fold

    return score(table(spark, sf_dir, "documents"), in_fold("doc_id", 5, 1))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from leadlight.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learned from preference pairs."""
    from leadlight.llm.quality import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a byte network."""
    from leadlight.llm.langid import train_and_predict

    return train_and_predict(table(spark, sf_dir, "documents"))


def op11_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label: links, components and which rows stay."""
    from leadlight.llm.vector_dups import vector_classes

    return vector_classes(table(spark, sf_dir, "embeddings"), least=0.98)


OP11_SQL = """
with recursive fit as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as a, b.vec_id as b from fit a join fit b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b)
select e.vec_id, (select count(*) from links where a = e.vec_id) as n_links,
  least(e.vec_id, coalesce((select min(b) from reached where a = e.vec_id), e.vec_id)) as component_id,
  least(e.vec_id, coalesce((select min(b) from reached where a = e.vec_id), e.vec_id)) = e.vec_id as kept
from embeddings e
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of integer clustering with eight centroids."""
    from leadlight.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dims=64, salt="3:").drop("computed")


def _op12_sql() -> str:
    near = "select p.vec_id, p.v, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as far from points p, {c} c qualify row_number() over (partition by p.vec_id order by far, c.cluster) = 1"
    text = """with points as materialized (
  select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as integer) as cluster, v from points qualify cluster < 8)"""
    for i in range(10):
        text += f""",
n{i} as materialized ({near.format(c=f"c{i}")}),
s{i} as (select cluster, i, cast(sum(v[i]) as hugeint) as s, count(*) as n from n{i}, range(1, 65) t(i) group by all),
m{i} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from s{i} group by cluster),
c{i + 1} as materialized (select c.cluster, coalesce(m.v, c.v) as v from c{i} c left join m{i} m on m.cluster = c.cluster)"""
    return text + f""",
last as materialized ({near.format(c="c10")})
select vec_id, l.cluster as cluster, cast(far as bigint) as distance, cast(sum(far) over (partition by l.cluster) as bigint) as cluster_inertia,
  cast(sum(far) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from last l join c10 c on c.cluster = l.cluster"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, a seventh of the labels being wrong on purpose."""
    from leadlight.llm.hard_negatives import mine

    ident, label = F.col("vec_id"), F.col("label")
    shifted = F.when(ident % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings"), ident % 50 == 0, shifted, positives=5, negatives=3, window=(50, 95), scale=256)


OP13_SQL = """
with rows as materialized (
  select cast(vec_id as bigint) as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
  select a.id as anchor_id, b.id as id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from rows a join rows b on a.id <> b.id and len(a.v) = len(b.v) where a.id % 50 = 0),
positives as (select anchor_id, id, score from scored where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id, cast(row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as integer) as rank,
  n.id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_media, op3_token_counts, op4_topk, op5_packing, op6_licenses, op7_brown_lm, op8_neardup, op9_quality, op10_langid, op11_vector_dups, op12_centroids, op13_hard_negatives, media_clip_rows, pipeline)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express on whole tables."""
    return {"op4_topk": OP4_SQL, "op11_vector_dups": OP11_SQL, "op12_centroids": _op12_sql(), "op13_hard_negatives": OP13_SQL}
