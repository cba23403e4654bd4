"""Connected components by contraction along pseudo-random minimum neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.materialize import materialize, release


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every endpoint of a non-loop edge; `component` is the smallest id reachable.

    Weak connectivity; NULL endpoints are dropped. Each round every vertex moves to the neighbour with
    the smallest rank (itself included), edges follow, loops vanish. The rank is the id in every other round, which
    ends stars around their smallest id at once, and a seeded hash in the others. An edge (x, m(x)) becomes
    (m(x), m(m(x))), so no connection is lost, and a constant share of the vertices goes in each hashed round
    whatever the shape: paths and stars take O(log n) rounds. The rounds' moves, each a table smaller than the
    one before, are put together at the end. Minima are pre-aggregated before the shuffle and joined from
    written tables, so a hub's rows can be split by adaptive skew handling.
    """
    a, b = F.col(src), F.col(dst)
    live = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    )
    hops: list[DataFrame] = []
    while not live.isEmpty():

        def rank(c: str, turn: int = len(hops)):
            return F.struct((F.xxhash64(F.lit(turn), F.col(c)) if turn % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("x"))

        both = live.select(F.col("u").alias("from"), rank("v").alias("to")).union(live.select("v", rank("u")))
        own = both.groupBy("from").agg(F.min("to").alias("to"))
        hop = materialize(own.select("from", F.least("to", rank("from")).getField("x").alias("to")))
        at_u = hop.select(F.col("from").alias("u"), F.col("to").alias("mu"))
        at_v = hop.select(F.col("from").alias("v"), F.col("to").alias("mv"))
        moved = live.join(at_u, "u").join(at_v, "v").where("mu <> mv")
        after = materialize(moved.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct())
        release(live)
        hops.append(hop)
        live = after
    if not hops:
        return live.select(F.col("u").alias("id"), F.col("v").alias("component"))
    # from the last, smallest hop back to the first: each vertex is followed to where it ends
    end = hops[-1]
    for turn, hop in enumerate(reversed(hops[:-1]), 1):
        on = end.select(F.col("from").alias("to"), F.col("to").alias("then"))
        end = hop.join(on, "to", "left").select("from", F.coalesce("then", "to").alias("to"))
        if turn % 4 == 0:
            end = materialize(end)
    labels = materialize(end.select(F.col("from").alias("id"), F.col("to").alias("label")))
    release(*hops)
    least = materialize(labels.groupBy("label").agg(F.min("id").alias("component")))
    return labels.join(least, "label").select("id", "component")
