"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, lines, mixing, near_dedup, quality, secrets, sharding, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), width=2, similar=80).drop("mark")


def op2_secrets_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fuzzy_lines(read(spark, sf_dir, "documents"), short=True).drop("h")


def op6_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


def op7_shard_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op9_decontaminate_lsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("mark")


def op10_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source, the path its language there."""
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_secrets_cnn,
        op3_mix_sources,
        op4_toxicity,
        op5_fuzzy_lines,
        op6_chat_role_repair,
        op7_shard_vector_packing,
        op8_exact_dedup,
        op9_decontaminate_lsa,
        op10_quality_bayes,
    )
}
ORACLES: dict[str, str] = {"op1_minhash_near_dedup": near_dedup.ORACLE_SQL, "op3_mix_sources": mixing.ORACLE_SQL, "op8_exact_dedup": exact_dedup.ORACLE_SQL}
