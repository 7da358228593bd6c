"""The registered queries of the operators and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    decontamination,
    exact_dedup,
    hard_negatives,
    licenses,
    mixing,
    quality,
    secrets,
    simhash,
    spelling,
    suffix_dedup,
    token_store,
    toxicity,
)
from .tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}


def _query(name: str):
    def register(build):
        QUERIES[name] = build
        return build

    return register


@_query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


@_query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination_report(documents(spark, sf_dir), benchmark)


@_query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@_query("op7_token_store")
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_report(spark, documents(spark, sf_dir))


@_query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_report(documents(spark, sf_dir), labels)


@_query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(documents(spark, sf_dir))


@_query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


@_query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_report(documents(spark, sf_dir), labels)


@_query("op10_chat")
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@_query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_report(documents(spark, sf_dir))


@_query("op11_exact_dedup")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, documents(spark, sf_dir))


@_query("op12_hard_negatives")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))
