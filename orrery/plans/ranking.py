"""Ranks and prefix sums over a whole table, without the single task of an unpartitioned window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans.materialize import materialize

_LOCAL = (1 << 33) - 1


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sorted(df: DataFrame, keys: Sequence[Column], partitions: int | None) -> DataFrame:
    """Range-partitioned and sorted; `_pid` and `_at` are the partition and the row's place in it."""
    placed = df.repartitionByRange(partitions or _parts(df), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    return materialize(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", place.bitwiseAND(F.lit(_LOCAL))))


def ranked(
    df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), out: str = "rank", partitions: int | None = None
) -> DataFrame:
    """`df` with `out`: the row's gapless 0-based place in `order`, inside its `within` group if given.

    One range exchange and one table of (partition, group) row counts, whose size the partitions
    and groups bound. Rows that tie on `order` get distinct places in an arbitrary order.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*within, *order)]
    base = _sorted(df, keys, partitions)
    by = list(within)
    counts = base.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        F.col("_pid").alias("_p"),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    on = F.col("_pid") == F.col("_p")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return base.join(materialize(offsets), on).select(*df.columns, place.cast("long").alias(out))


def running_sum(df: DataFrame, order: Sequence[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """`df` with `out`: the sum of `value` over all rows before this one in `order` (exclusive)."""
    base = _sorted(df, [F.col(c) for c in order], partitions)
    inside = W.partitionBy("_pid").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    totals = base.groupBy("_pid").agg(F.sum(value).alias("_n"))
    # one row for each partition
    offsets = totals.select(
        F.col("_pid").alias("_p"),
        F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        base.withColumn("_local", local)
        .join(materialize(offsets), F.col("_pid") == F.col("_p"))
        .select(*df.columns, (F.col("_local") + F.col("_before")).alias(out))
    )
