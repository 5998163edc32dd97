"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import extract, language, lines, media, packing, pieces, quality, secrets, simhash, urls
from tidelog.llm.common import checkpoint_root, documents, pages


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(documents(spark, sf_dir))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(pages(spark, sf_dir))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(pages(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def media_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can have."""
    return media.media_columns(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can have."""
    return quality.rule_statistics(documents(spark, sf_dir)).drop("features")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can have."""
    return secrets.scan_documents(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex")


def secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of all documents is scanned only where it differs from the first."""
    return secrets.scan_versions(documents(spark, sf_dir), f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scans": op7_secret_scans,
    "op8_html_extraction": op8_html_extraction,
    "op9_url_filters": op9_url_filters,
    "op10_line_dedup": op10_line_dedup,
    "media_bytes": media_bytes,
    "quality_statistics": quality_statistics,
    "secret_counts": secret_counts,
    "secret_ledger": secret_ledger,
}

SQL: dict[str, str] = {
    "op9_url_filters": urls.judge_sql(),
    "op10_line_dedup": lines.report_sql(),
    "media_bytes": media.bytes_sql(),
    "quality_statistics": quality.statistics_sql(),
    "secret_counts": secrets.base_counts_sql(),
    "secret_ledger": secrets.scan_versions_sql(),
}
