"""From raw documents to token ids: each stage works on what its predecessor kept.

toxicity        documents scored 0.5 or more go
near_dedup      one document of each group of near-duplicates stays
decontaminate   documents that hold a passage (a window of eight words) of any benchmark item go
mix             documents are taken so often that sources meet their target weights
tokens          ids are written in shards and read back as one digest for each document taken

All stages but the last return the columns of documents. Models and labels are read from sf_dir; a stage's
counts are over the documents it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontamination, mixing, queries, simhash, tokens, toxicity
from orrery.plans import materialize
from orrery.plans.materialize import fresh_path
from orrery.session import share_package


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokens.write_tokens(docs, path, queries.tokenizer_path())
    return tokens.read_digests(spark.read.parquet(path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", token_shards),
]

#: SQL has no models, fingerprints or tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage's output written and read again in between."""
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
