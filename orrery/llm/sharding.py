"""Shards of near-equal bytes by a k-d tree over metadata.

Dimensions are source, lang and size, each as the place of its value in the order of all bytes (the middle of the
value's bytes, in BINS bins), so that widths compare. From the root on, a node is cut along its widest dimension
at the weighted median, found from sums over bins; values in the bin that holds the median are cut by a hash, so
a hot source is divided like any other. Nodes are cut until each holds what one shard is to hold: of `shards`, or
of as many as `target_bytes` asks for.

What moves is a group of equal texts, with its smallest source, lang and size: copies share a shard, always. Groups
of more than 1 / SPLIT of a shard's bytes, fewer than SPLIT times as many as shards, are dealt first, largest
first, each to the least filled shard; the tree then fills up the shards to one level. A group larger than a shard
has one to itself, and the others share the rest evenly.

Null text has no bytes; null source, lang and doc_id sort as the empty string and first. Repeated rows have slots
of their own. A very long text weighs its bytes. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans import materialize, ranked, release, running_sum

SHARDS = 16
SPLIT = 64
BINS = 256
HASH_BITS = 12
DIMENSIONS = ("d_source", "d_lang", "d_size")


def dealt(large: list[int], shards: int, rest: int) -> tuple[list[int], list[float]]:
    """The shard of each large group, and the bytes of other rows that bring every shard to one level."""
    filled = [(0, i) for i in range(shards)]
    heapify(filled)
    place = [0] * len(large)
    for g in sorted(range(len(large)), key=lambda g: -large[g]):
        b, i = filled[0]
        place[g] = i
        heapreplace(filled, (b + large[g], i))
    ascending = sorted(b for b, _ in filled)
    level, sofar = 0.0, 0
    for k, b in enumerate(ascending, 1):
        sofar += b
        level = (rest + sofar) / k
        if k < shards and level <= ascending[k]:
            break
    room = [0.0] * shards
    for b, i in filled:
        room[i] = max(0.0, level - b)
    return place, room


def _binned(units: DataFrame, value: str, out: str, total: int) -> DataFrame:
    """units with the bin of the middle of their value's bytes."""
    sums = materialize(units.groupBy(value).agg(F.sum("w").alias("w")))
    place = F.floor((F.col("before") + F.col("w") / 2) * BINS / F.lit(max(total, 1))).cast("int")
    return units.join(materialize(running_sum(sums, [value], "w", "before").select(value, place.alias(out))), value)


def _cuts(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """shard, mid, d, bin and h of nodes (shard, mid, share): where along which dimension the right side begins.

    `share` of a node's bytes goes to its left side. At most nodes x dimensions x BINS sums are ordered, and
    nodes x 2^HASH_BITS.
    """
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(c).alias("bin")) for i, c in enumerate(DIMENSIONS)]))
    stacked = units.join(F.broadcast(nodes), "shard").select("shard", "mid", "share", "w", bins.alias("at"))
    sums = materialize(stacked.groupBy("shard", "mid", "share", "at.d", "at.bin").agg(F.sum("w").alias("w")))
    width = sums.groupBy("shard", "d").agg((F.max("bin") - F.min("bin")).alias("width"))
    widest = width.groupBy("shard").agg(F.min(F.struct(-F.col("width"), "d")).getField("d").alias("d"))
    node = W.partitionBy("shard")
    along = sums.join(widest, ["shard", "d"]).select(
        "shard", "mid", "d", "bin", (F.sum("w").over(node.orderBy("bin")) - F.col("w")).alias("before"), "w", (F.sum("w").over(node) * F.col("share")).alias("left")
    )
    reached = along.where(F.col("before") + F.col("w") >= F.col("left")).groupBy("shard", "mid", "d").agg(F.min(F.struct("bin", F.col("left") - F.col("before"))).alias("x"))
    at = materialize(reached.select("shard", "mid", "d", F.col("x.bin").alias("bin"), F.col("x.col2").alias("want")))
    here = units.join(F.broadcast(at), "shard").where(F.array(*DIMENSIONS)[F.col("d")] == F.col("bin"))
    fine = here.groupBy("shard", "mid", "d", "bin", "want", "h").agg(F.sum("w").alias("w"))
    over = fine.withColumn("before", F.sum("w").over(node.orderBy("h")) - F.col("w"))
    first = F.min(F.when(F.col("before") + F.col("w") / 2 > F.col("want"), F.col("h")))
    return materialize(over.groupBy("shard", "mid", "d", "bin").agg(F.coalesce(first, F.lit(1 << HASH_BITS)).alias("h_cut")))


def tree(units: DataFrame, room: list[float]) -> DataFrame:
    """g and shard of units (g, w, h and DIMENSIONS): nodes are runs of shards, named by their first."""
    spark, nodes = units.sparkSession, [(0, len(room))]
    units = materialize(units.withColumn("shard", F.lit(0)))
    while any(hi - lo > 1 for lo, hi in nodes):
        halves = [(lo, (lo + hi) // 2, hi) for lo, hi in nodes if hi - lo > 1]
        shares = [(lo, mid, (sum(room[lo:mid]) / whole) if (whole := sum(room[lo:hi])) else 1.0) for lo, mid, hi in halves]
        # a row a node, no more than shards
        cuts = _cuts(units, spark.createDataFrame(shares, "shard int, mid int, share double"))
        value = F.array(*DIMENSIONS)[F.col("d")]
        right = (value > F.col("bin")) | ((value == F.col("bin")) & (F.col("h") >= F.col("h_cut")))
        moved = units.join(F.broadcast(cuts), "shard", "left").select("g", "w", "h", *DIMENSIONS, F.when(right, F.col("mid")).otherwise(F.col("shard")).alias("shard"))
        after = materialize(moved)
        release(units)
        units, nodes = after, [x for lo, hi in nodes for x in ([(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)] if hi - lo > 1 else [(lo, hi)])]
    return units.select("g", "shard")


def placed_units(groups: DataFrame) -> DataFrame:
    """groups (g, w, source, lang, size) with h and the bins of DIMENSIONS."""
    units = materialize(groups.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(5), "g"), 64 - HASH_BITS).cast("int")))
    total = units.agg(F.sum("w")).first()[0] or 0
    for value, d in zip(("source", "lang", "size"), DIMENSIONS, strict=True):
        units = _binned(units, value, d, total)
    return materialize(units.select("g", "w", "h", *DIMENSIONS))


def kd_shards(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """rows (doc_id, size, g, source, lang) with `shard`; g tells texts apart."""
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("size").alias("size"))
    groups = materialize(groups)
    total = groups.agg(F.sum("w")).first()[0] or 0
    shards = shards or max(1, -(-total // (target_bytes or total or 1)))
    is_large = F.col("w") * shards * SPLIT > F.lit(total)
    large = [(r["g"], r["w"]) for r in groups.where(is_large).select("g", "w").orderBy(F.desc("w"), "g").collect()]  # fewer than shards x SPLIT rows
    place, room = dealt([w for _, w in large], shards, total - sum(w for _, w in large))
    first = rows.sparkSession.createDataFrame([(g, i) for (g, _), i in zip(large, place, strict=True)], "g long, shard int")
    of = first.union(tree(placed_units(groups.where(~is_large)), room))
    return rows.join(materialize(of), "g")


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot and grown_shard (null) of every document."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
    )
    placed = kd_shards(materialize(rows), shards).select("doc_id", "size", "text_crc32", "shard")
    slots = ranked(placed, ["doc_id", "text_crc32"], ["shard"], out="slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
