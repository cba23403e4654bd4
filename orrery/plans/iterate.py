"""The driver loop of iterative plans: a table a round, written, so that lineage and plans stay short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.materialize import materialize, release


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, int], bool], rounds: int | None = None) -> DataFrame:
    """step(state, round) from round 1 on, until done(state, round) or `rounds` rounds; the last state.

    Each state is written once and both the stop test and the next round read that table; the one before is
    deleted.
    """
    state, turn = materialize(state), 0
    while rounds is None or turn < rounds:
        turn += 1
        after = materialize(step(state, turn))
        release(state)
        state = after
        if done(state, turn):
            break
    return state


def partitioned(edges: DataFrame, key: str) -> DataFrame:
    """The edges with both ends, in memory or on disk by hash of `key`: each round shuffles its state only.

    Executors that are lost take blocks with them that are computed anew from what `edges` reads. Partitions
    are balanced by `key`; for a graph with hubs use `salted`.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.where("src is not null and dst is not null").repartition(parts, key).persist()


#: Out-edges of one vertex that stay together; those of a vertex with more are dealt over several salts.
HUB = 1 << 16


def salted(edges: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame | None]:
    """(edges, hubs): edges by hash of (src, salt), and the hubs (src, salt; salts from 1 on), None if there are none.

    A source of more than `hub` edges has them dealt over as many salts as keep each below it, so that no task holds a
    hub's edges alone; `sent` gives a state's rows the salts to meet them. There are fewer salts than edges / hub.
    """
    whole = edges.where("src is not null and dst is not null")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = whole.groupBy("src").count().where(F.col("count") > hub).select("src", F.ceil(F.col("count") / hub).cast("int").alias("salts"))
    heavy = materialize(heavy)
    if heavy.isEmpty():
        return whole.withColumn("salt", F.lit(0)).repartition(parts, "src", "salt").persist(), None
    salt = F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")
    kept = whole.join(heavy, "src", "left").withColumn("salt", salt).drop("salts").repartition(parts, "src", "salt").persist()
    more = heavy.select("src", F.explode(F.sequence(F.lit(1), F.col("salts") - 1)).alias("salt"))
    return kept, materialize(more)


def sent(state: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """state (src, ...) with salt: a row for each salt of its source."""
    first = state.withColumn("salt", F.lit(0))
    return first if hubs is None else first.unionByName(state.join(hubs, "src").select(first.columns))
