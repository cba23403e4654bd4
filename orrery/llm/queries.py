"""The queries of this package: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontamination, langid, lines, mixing, quality, sharding, simhash, sql, tokens, toxicity, urls
from orrery.plans.materialize import fresh_path
from orrery.session import share_package


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokens.write_tokens(_read(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.read_digests(spark.read.parquet(path))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(_read(spark, sf_dir, "documents"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_token_shards": op7_token_shards,
    "op8_line_dedup": op8_line_dedup,
    "op9_kd_shards": op9_kd_shards,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": sql.DECONTAMINATION,
    "op10_url_filter": sql.URL_FILTER,
}
