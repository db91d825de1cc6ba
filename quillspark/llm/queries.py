"""Queries of the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import read
from quillspark.llm.decontaminate import contained_items
from quillspark.llm.divergence import ORACLE as DIVERGENCE_SQL
from quillspark.llm.divergence import source_divergence
from quillspark.llm.langid import predict_languages
from quillspark.llm.license_scan import license_matches
from quillspark.llm.license_scan import oracle as license_sql
from quillspark.llm.media import text_media
from quillspark.llm.mixing import by_position, mix_plan
from quillspark.llm.near_dedup import near_duplicates
from quillspark.llm.quality import quality_scores
from quillspark.llm.secret_scan import secret_spans
from quillspark.llm.tokens import tokenized
from quillspark.llm.toxicity import toxicity_scores
from quillspark.llm.vector_dedup import near_duplicate_vectors
from quillspark.llm.whitening import whitened


def op1_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_scores(docs.select("doc_id", "text"), labels, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op2_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), size=4, percent=80)


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity_scores(docs.select("doc_id", "text"), labels, threshold=0.5).select("doc_id", "held_out", "score", "predicted")


def op7_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read(spark, sf_dir, "documents"))


def op8_randomness_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read(spark, sf_dir, "documents"))


def op9_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")
    return by_position(plan, "first_position", "doc_id")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight,
         (source_size * 3)::DOUBLE AS room,
         row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM sources
), split AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(room) OVER w, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT level FROM split WHERE level * weight <= room ORDER BY room / weight, rank LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR room < level * weight THEN room ELSE level * weight END AS target,
         [0.5::DOUBLE, 0::DOUBLE, -0.5::DOUBLE][(rank - 1) % 3 + 1] AS tilt
  FROM (SELECT split.source, source_size, room, weight, rank, chosen.level FROM split LEFT JOIN chosen ON TRUE)
), placed AS (
  SELECT doc_id, source, size,
         (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized
), plan AS (
  SELECT doc_id, size, source_size, target, tilt, start,
    (CASE WHEN source_size > 0 THEN (round(target)::BIGINT // source_size) ELSE 0 END * size
     + greatest(0, least(size, round(target)::BIGINT
         - CASE WHEN source_size > 0 THEN (round(target)::BIGINT // source_size) ELSE 0 END * source_size - start)))::BIGINT AS taken
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
), asked AS (
  SELECT *, start / greatest(target, 1e-9) AS first_asked, (start + (taken - 1) // greatest(size, 1) * source_size) / greatest(target, 1e-9) AS last_asked FROM plan
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN first_asked ELSE (sqrt(greatest(0, (1 - tilt) * (1 - tilt) + 4 * tilt * first_asked)) - (1 - tilt)) / (2 * tilt) END END AS first_position,
  CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN last_asked ELSE (sqrt(greatest(0, (1 - tilt) * (1 - tilt) + 4 * tilt * last_asked)) - (1 - tilt)) / (2 * tilt) END END AS last_position
FROM asked
"""


def op6_parquet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(read(spark, sf_dir, "documents"))


def op10_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"))


def op11_level_product_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))


def op13_projection_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ftrl_quality": op1_ftrl_quality,
    "op4_hyperminhash_near_dedup": op4_hyperminhash_near_dedup,
    "op5_counterfactual_toxicity": op5_counterfactual_toxicity,
    "op6_parquet_token_ids": op6_parquet_token_ids,
    "op7_license_sentence_rules": op7_license_sentence_rules,
    "op8_randomness_secret_scan": op8_randomness_secret_scan,
    "op9_byte_cnn_langid": op9_byte_cnn_langid,
    "op10_media_archive": op10_media_archive,
    "op2_greedy_string_tiling": op2_greedy_string_tiling,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op11_level_product_divergence": op11_level_product_divergence,
    "op12_lanczos_whitening": op12_lanczos_whitening,
    "op13_projection_forest_dedup": op13_projection_forest_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_curriculum_mix": OP3_SQL,
    "op7_license_sentence_rules": license_sql(),
    "op11_level_product_divergence": DIVERGENCE_SQL,
}
