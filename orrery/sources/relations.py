"""Synthetic key/payload relations, generated where they are read."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def relation_pk(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Unique keys: row i has key i + 1 and payload i + 2."""
    i = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return i.select((F.col("id") + 1).alias("key"), (F.col("id") + 2).alias("payload"))


def relation_permuted(spark: SparkSession, n: int, step: int = 7919) -> DataFrame:
    """relation_pk with its keys in another, fixed order; payloads stay where they are."""
    while gcd(step, n) != 1:
        step += 1
    i = spark.range(n)
    return i.select(((F.col("id") * step) % n + 1).alias("key"), (F.col("id") + 2).alias("payload"))


def relation_hashed(spark: SparkSession, n: int, spread: int = 256) -> DataFrame:
    """Keys hash(i) % spread * n + i: unique, scattered, the same in every run; a multiplicative hash of i's low 31 bits."""
    i = F.col("id")
    h = F.shiftright((i.bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 16)
    return spark.range(n).select((h % spread * n + i).alias("key"), (i + 2).alias("payload"))


def relation_slice(relation: DataFrame, offset: int, count: int, index: str = "row_idx") -> DataFrame:
    """Rows offset .. offset + count of a relation with a stored row index; the range reaches the scan."""
    return relation.where((F.col(index) >= offset) & (F.col(index) < offset + count))


def active_vertices(spark: SparkSession, n: int, rounds: int = 1) -> DataFrame:
    """Input of the scatter-add benchmark: `rounds` pseudo-random ids below n for each of n rows."""
    h = (F.col("id").bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
    return spark.range(n * rounds).select((F.shiftright(h, 8) % n).alias("v"))
