"""Queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, linededup, matroska, mixing, oracles, piece_bpe, quality, sharding, suffix, tokencount, toxicity
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(table(spark, sf_dir, "documents"))


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report_documents(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_matroska, op2_bagminhash, op3_toxicity, op4_suffix_dedup, op5_line_dedup, op6_sentencepiece, op7_token_counts, op8_quality_rules, op9_sharding, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": oracles.OP5, "op8_quality_rules": oracles.OP8, "op10_mixing": oracles.OP10}
