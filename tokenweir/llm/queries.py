"""The registered queries of the training-data operators, over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, html, huffman, importance, linededup, minhash, packing, ppm, quality, sharding, tokencount, toxicity
from .common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op1_minhash_dedup(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op2_line_dedup(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op3_html_extraction(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op4_token_counts(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5_sharding(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op6_packing(table(spark, sf_dir, "documents"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.op7_token_binary(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8_quality_rules(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op9_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op11_divergence(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.op12_importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.op13_language_model(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_token_binary": op7_token_binary,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_importance": op12_importance,
    "op13_language_model": op13_language_model,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op9_decontamination": decontam.ORACLE_SQL,
    "op11_divergence": divergence.ORACLE_SQL,
    "op12_importance": importance.ORACLE_SQL,
}
