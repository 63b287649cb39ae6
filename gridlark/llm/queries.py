"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_cnn, centroids, compaction, jaccard_join, lattice_lm, media, mixing, packing, pii, quality, suffix_dedup, token_counts, toxicity
from .common import table


def op1_token_counts(spark, sf_dir):
    return token_counts.attributed_tokens(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op3_lattice_lm(spark, sf_dir):
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark, sf_dir):
    return pii.with_surrogates(table(spark, sf_dir, "documents")).select("doc_id", "text", F.col("pii_count").alias("n_replaced"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op7_media_columns(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_centroids(spark, sf_dir):
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_compaction(spark, sf_dir):
    return compaction.compact(table(spark, sf_dir, "clicks"))


def op13_byte_cnn(spark, sf_dir):
    return byte_cnn.predict_languages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_lattice_lm, op4_pii_surrogates, op5_jaccard_join, op6_toxicity, op7_media_columns, op8_mixing, op9_packing, op10_suffix_dedup, op11_centroids, op12_compaction, op13_byte_cnn)}

ORACLE_SQL = {
    "op2_quality_rules": quality.ORACLE,
    "op11_centroids": centroids.oracle(),
    "op8_mixing": r"""
WITH s AS (SELECT doc_id, source, md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS h, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS clamp, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY clamp / weight, source NULLS LAST) AS k FROM w),
f AS (SELECT *, (budget - coalesce(sum(clamp) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT arg_min(level, k) AS level FROM f WHERE clamp > level * weight),
g AS (SELECT source, source_size, CASE WHEN m.level IS NULL THEN clamp ELSE least(clamp, m.level * weight) END AS target FROM f CROSS JOIN m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
c AS (SELECT s.doc_id, s.size, e.source_size, e.target, e.whole, CAST(floor(e.target - e.whole * e.source_size + 0.5) AS BIGINT) AS rest,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
""",
}
