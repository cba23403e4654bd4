"""Equi-joins over (key, payload) relations, their partitions, lanes and bucketised tables.

Keys that are NULL never match. Physical strategy is left to Catalyst: a small side is broadcast by its
size, large ones are shuffled on the key, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.scalar import radix_hash
from orrery.plans import ranked

SLOTS = 4


def join_rows(r: DataFrame, s: DataFrame) -> DataFrame:
    """key, s_payload, r_payload of every match."""
    right = r.select("key", F.col("payload").alias("r_payload"))
    return s.select("key", F.col("payload").alias("s_payload")).join(right, "key").select("key", "s_payload", "r_payload")


def join_count(r: DataFrame, s: DataFrame) -> DataFrame:
    """One row: the matches of r and s, as a plain join."""
    return s.select("key").join(r.select("key"), "key").agg(F.count(F.lit(1)).alias("matches"))


def key_counts(r: DataFrame, out: str = "n") -> DataFrame:
    """Rows of each key; NULL keys are dropped, as they match nothing."""
    return r.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias(out))


def join_count_preaggregated(r: DataFrame, s: DataFrame) -> DataFrame:
    """join_count with each side counted by key first: a row a key crosses the network, however hot the key."""
    both = key_counts(r, "nr").join(key_counts(s, "ns"), "key")
    return both.agg(F.coalesce(F.sum(F.col("nr") * F.col("ns")), F.lit(0)).alias("matches"))


def match_counts(r: DataFrame, s: DataFrame, by: Column, out: str) -> DataFrame:
    """Matches of r and s by a function of the key, from counts by key."""
    both = key_counts(r, "nr").join(key_counts(s, "ns"), "key")
    return both.groupBy(by.alias(out)).agg(F.sum(F.col("nr") * F.col("ns")).alias("matches"))


def lane_counts(r: DataFrame, s: DataFrame, lanes: int) -> DataFrame:
    """Matches in each of `lanes` (a power of two) lanes of keys; the lanes' sum is join_count."""
    return match_counts(r, s, F.col("key").cast("bigint").bitwiseAND(F.lit(lanes - 1).cast("bigint")), "lane")


def radix_histogram(r: DataFrame, bits: int, shift: int = 0) -> DataFrame:
    """Rows of each of the 2^bits partitions by the key's bits from `shift` on."""
    part = radix_hash(F.col("key"), ((1 << bits) - 1) << shift, shift)
    return r.where("key is not null").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))


def radix_partition(r: DataFrame, bits: tuple[int, ...]) -> DataFrame:
    """r with `part`: the passes' bits, low bits first, as one number, so that passes are one shuffle at most."""
    part, shift = F.lit(0).cast("bigint"), 0
    for b in bits:
        part = part.bitwiseOR(F.call_function("shiftleft", radix_hash(F.col("key"), ((1 << b) - 1) << shift, shift), F.lit(shift)))
        shift += b
    return r.withColumn("part", part)


def pair_sizes(r: DataFrame, s: DataFrame, bits: int, shift: int = 0) -> DataFrame:
    """Partitions in which both sides have rows, with the rows of each; the others need no join."""
    a = radix_histogram(r, bits, shift).withColumnRenamed("rows", "r_rows")
    return a.join(radix_histogram(s, bits, shift).withColumnRenamed("rows", "s_rows"), "part")


def hash_table(r: DataFrame, buckets: int) -> DataFrame:
    """bucket, slot, key, payload: r as a table of buckets by key modulo `buckets`, slots in key order.

    Slots are places in one order of all rows, so that a bucket of many rows is spread over tasks.
    """
    bucket = F.pmod(F.col("key").cast("bigint"), F.lit(buckets).cast("bigint"))
    rows = r.where("key is not null").select(bucket.alias("bucket"), "key", "payload")
    return ranked(rows, ["key", "payload"], ["bucket"], out="slot").select("bucket", "slot", "key", "payload")


def hash_table_checks(table: DataFrame, buckets: int, slots: int = SLOTS) -> DataFrame:
    """One row: keys in a wrong bucket, buckets in use, buckets over `slots`, the fullest, and all rows."""
    wrong = F.pmod(F.col("key").cast("bigint"), F.lit(buckets).cast("bigint")) != F.col("bucket")
    per = table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("w"))
    return per.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("wrong_bucket"),
        F.count(F.lit(1)).alias("used_buckets"),
        F.count_if(F.col("n") > slots).alias("over_full"),
        F.coalesce(F.max("n"), F.lit(0)).alias("fullest"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )


def skew_split_join(r: DataFrame, s: DataFrame, buckets: int, slots: int = SLOTS) -> DataFrame:
    """part (main, overflow), matches: r's rows from the slot `slots` of a bucket on are joined apart.

    The two parts' matches add up to join_count. Rows are counted by key first, and a key's place in its bucket is the
    sum of the counts before it, so that a hot key is one row; runtime skew of the join is left to adaptive execution.
    """
    bucket = F.pmod(F.col("key").cast("bigint"), F.lit(buckets).cast("bigint"))
    before = W.partitionBy(bucket).orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    main = F.greatest(F.least(F.lit(slots) - F.coalesce(F.sum("n").over(before), F.lit(0)), F.col("n")), F.lit(0))
    parts = key_counts(r).select("key", main.alias("main"), (F.col("n") - main).alias("overflow"))
    cells = parts.unpivot("key", ["main", "overflow"], "part", "nr").where("nr > 0")
    return cells.join(key_counts(s, "ns"), "key").groupBy("part").agg(F.sum(F.col("nr") * F.col("ns")).alias("matches"))


def write_bucketed(r: DataFrame, table: str, buckets: int) -> None:
    """Store r bucketed and sorted by key: two tables of equal buckets join without a shuffle."""
    r.write.bucketBy(buckets, "key").sortBy("key").mode("overwrite").saveAsTable(table)


def join_count_bucketed(spark: SparkSession, r: str, s: str) -> DataFrame:
    """join_count of two tables that `write_bucketed` stored with equal buckets: no side is shuffled."""
    return join_count(spark.table(r), spark.table(s))
