"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard_join, licenses, media, mixing, pii, quality, suffix_dedup, token_counts, token_output
from .common import documents

THRESHOLD = 0.3


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.annotate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), window=10)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(documents(spark, sf_dir))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "private")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.read_back(media.metadata(media.pack(documents(spark, sf_dir))), tail=32)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), length=400, report=256).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), most=3)
    return rows.withColumn("target", F.round("target", 6)).withColumn("position", F.round("position", 9))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, documents(spark, sf_dir, "labels")), THRESHOLD)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), threshold=0.8, windows=True).select("doc_id", "licenses", "best_license", "best_dice")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_pii,
        op3_media_columns,
        op4_jaccard_join,
        op5_token_counts,
        op6_suffix_array_dedup,
        op7_mixing_sources,
        op8_quality_classifier,
        op9_license_scans,
        op10_token_output,
    )
}
#: DuckDB SQL of those that SQL can express.
ORACLE_SQL: dict[str, str] = {"op7_mixing_sources": mixing.oracle_sql(), "op9_license_scans": licenses.oracle_sql()}
