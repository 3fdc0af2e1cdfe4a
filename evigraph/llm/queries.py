"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, filter_audit, merkle, mixing, near_dedup, pii, quality, repetition, suffix_lm, token_counts, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix_counts(_documents(spark, sf_dir)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(_documents(spark, sf_dir))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_documents(spark, sf_dir), n=2, percent=80)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_documents(spark, sf_dir)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_toxicity,
        op3_repetition,
        op4_mixing,
        op5_token_counts,
        op6_exact_dedup,
        op7_quality,
        op8_suffix_lm,
        op9_urls,
        op10_near_dedup,
        op11_pii,
        op12_merkle,
        op13_filter_audit,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
