"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, html_main, mixing, near_dup, packing, quality, secrets, token_counts, toxicity, warc
from millrace.llm.common import documents, labels, pages


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(pages(spark, sf_dir)), payloads=False)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(pages(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(documents(spark, sf_dir)).select("doc_id", "n_tokens")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_roundtrip": op1_warc_roundtrip,
    "op2_main_text": op2_main_text,
    "op3_token_counts": op3_token_counts,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_toxic_segments": op6_toxic_segments,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op1_warc_roundtrip": warc.ORACLE, "op5_mix_sources": mixing.ORACLE, "op7_secret_scan": secrets.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
