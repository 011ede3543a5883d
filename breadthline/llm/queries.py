"""The operators' registered queries, each over its whole table, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from breadthline.llm import (
    alignment,
    decontaminate,
    fingerprint,
    jaccard,
    language,
    manifest,
    packing,
    quality,
    secrets,
    sharding,
    token_files,
    tokens,
    toxicity,
)
from breadthline.llm.common import table


def op1_quality_network(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, folder, "documents"))


def op5_merkle_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, folder, "documents"))


def op6_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return language.language(table(spark, folder, "documents"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op9_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_files(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(table(spark, folder, "documents"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run for run in (
        op1_quality_network, op2_secret_forest, op3_token_counts, op4_jaccard_join,
        op5_merkle_fingerprints, op6_language_profiles, op7_decontamination,
        op8_best_fit_packing, op9_stratified_shards, op10_toxicity, op11_token_files,
        op12_merkle_manifest, op13_token_alignment)
}

#: The others cannot be put in SQL: they learn, tokenize or use hashes that SQL does not have. Tests
#: hold them against brute-force versions instead.
ORACLES: dict[str, str] = {"op12_merkle_manifest": manifest.SQL}
