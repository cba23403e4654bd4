"""Breadth-first search, shortest paths, components and PageRank, one written table a round.

Unreached vertices have NULL (or `unreached` where given). PageRank drops the mass of vertices without
out-edges, so ranks add up to less than 1 where there are any. Components are weak and complete. Edges are
taken as given; repeated ones count in PageRank and change nothing elsewhere. `dense` (id) gives the vertices where
they are more than 0 .. largest id of an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import graph
from orrery.operators.components import components
from orrery.operators.program import shortest
from orrery.plans import iterate, materialize, partitioned, release, salted, sent

DAMPING = 0.85
#: Device damping: (108 t) >> 7.
FIXED_DAMPING, FIXED_SHIFT = 108, 7


def _start(spark, source: int) -> DataFrame:
    return spark.range(source, source + 1).select("id", F.lit(0).cast("bigint").alias("depth"))


def _over_vertices(edges: DataFrame, reached: DataFrame, value: str, unreached: int | None, dense: DataFrame | None) -> DataFrame:
    every = graph.vertices(edges) if dense is None else dense
    got = F.col(value) if unreached is None else F.coalesce(value, F.lit(unreached).cast("bigint"))
    return every.join(reached, "id", "left").select("id", got.alias(value))


def bfs_step(edges: DataFrame, depths: DataFrame, level: int) -> DataFrame:
    """depths (id, depth) of the vertices that the frontier of `level` reaches first, at level + 1."""
    frontier = depths.where(F.col("depth") == level).select(F.col("id").alias("src"))
    found = graph.whole(edges).join(frontier, "src").select(F.col("dst").alias("id")).distinct()
    return found.join(depths, "id", "left_anti").select("id", F.lit(level + 1).cast("bigint").alias("depth"))


def bfs(edges: DataFrame, source: int, unreached: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """id, depth by level-synchronous push from `source` over unit edges."""
    kept, hubs = salted(edges.select("src", "dst"))
    state = materialize(_start(edges.sparkSession, source))
    frontier, level = state, 0
    try:
        while True:
            found = kept.join(sent(frontier.select(F.col("id").alias("src")), hubs), ["src", "salt"]).select(F.col("dst").alias("id")).distinct()
            new = materialize(found.join(state, "id", "left_anti").select("id", F.lit(level + 1).cast("bigint").alias("depth")))
            if new.isEmpty():
                return _over_vertices(edges, state, "depth", unreached, dense)
            state, frontier, level = state.union(new), new, level + 1
            if level % 12 == 0:  # unions of many tables plan slowly
                state = materialize(state)
    finally:
        kept.unpersist()


def bfs_pull(edges: DataFrame, source: int, unreached: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """id, depth: neighbours of what changed take the least depth over their in-edges; same fixpoint as bfs."""
    unit = partitioned(edges.select("src", "dst").distinct(), "dst")
    every = graph.vertices(edges) if dense is None else dense
    first = every.select("id", F.when(F.col("id") == source, 0).cast("bigint").alias("depth"), (F.col("id") == source).alias("active"))

    def step(state: DataFrame, _: int) -> DataFrame:
        senders = state.where("active").select(F.col("id").alias("src"))
        called = unit.join(senders, "src", "left_semi").select("dst").distinct()
        have = state.where("depth is not null").select(F.col("id").alias("src"), "depth")
        pulled = unit.join(called, "dst", "left_semi").join(have, "src").groupBy(F.col("dst").alias("id")).agg((F.min("depth") + 1).alias("pulled"))
        new = F.least("depth", "pulled")
        return state.join(pulled, "id", "left").select("id", new.alias("depth"), (~new.eqNullSafe(F.col("depth"))).alias("active"))

    try:
        end = iterate(first, step, lambda s, _: s.where("active").isEmpty()).select("id", "depth")
        return end if unreached is None else end.select("id", F.coalesce("depth", F.lit(unreached).cast("bigint")).alias("depth"))
    finally:
        unit.unpersist()


def bfs_blocked(edges: DataFrame, source: int, block: int, unreached: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """id, depth over a grid: edges are laid out by block of source, and a frontier meets only its own blocks."""
    kept = partitioned(graph.with_blocks(edges, block).select("blk_x", "src", "dst"), "blk_x")
    state = materialize(_start(edges.sparkSession, source))
    frontier, level = state, 0
    try:
        while True:
            mine = frontier.select(F.floor(F.col("id") / block).cast("bigint").alias("blk_x"), F.col("id").alias("src"))
            found = kept.join(mine, ["blk_x", "src"]).select(F.col("dst").alias("id")).distinct()
            new = materialize(found.join(state, "id", "left_anti").select("id", F.lit(level + 1).cast("bigint").alias("depth")))
            if new.isEmpty():
                return _over_vertices(edges, state, "depth", unreached, dense)
            state, frontier, level = state.union(new), new, level + 1
            if level % 12 == 0:
                state = materialize(state)
    finally:
        kept.unpersist()


def level_sizes(depths: DataFrame) -> DataFrame:
    """depth, size: the frontier trace of a search."""
    return depths.where("depth is not null").groupBy("depth").agg(F.count(F.lit(1)).alias("size"))


def sssp(edges: DataFrame, source: int, rounds: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """id, distance over non-negative `weight`; NULL where there is no path."""
    every = graph.vertices(edges) if dense is None else dense
    first = every.select(
        "id", F.when(F.col("id") == source, 0).cast("bigint").alias("value"), (F.col("id") == source).alias("active")
    )
    return shortest().run(edges, first, rounds).withColumnRenamed("value", "distance")


def connected_components(edges: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """id, component of every vertex: the smallest id that it is weakly connected to."""
    found = components(edges)
    every = graph.vertices(edges) if dense is None else dense
    return every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """component, size."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def _with_out_degree(edges: DataFrame, dense: DataFrame | None) -> DataFrame:
    return materialize(graph.degrees(edges, dense).select("id", F.col("out_deg").alias("deg")))


def pagerank(
    edges: DataFrame,
    rounds: int = 19,
    tolerance: float | None = 0.001,
    damping: float = DAMPING,
    trace: list | None = None,
    dense: DataFrame | None = None,
) -> DataFrame:
    """id, rank: (1 - d) / n + d * sum of rank / out-degree over in-edges, from 1 / n.

    Stops after `rounds`, or once the ranks change by less than `tolerance` in sum; `trace` gets each round's
    change. Rank over degree is computed once a vertex, not once an edge.
    """
    deg = _with_out_degree(edges, dense)
    n = deg.count()
    if not n:
        return deg.select("id", F.lit(0.0).alias("rank"))
    kept, hubs = salted(edges.select("src", "dst"))
    base = (1 - damping) / n

    def step(state: DataFrame, _: int) -> DataFrame:
        share = state.where("deg > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("share"))
        sums = kept.join(sent(share, hubs), ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        new = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        return state.join(sums, "id", "left").select("id", "deg", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))

    def done(state: DataFrame, _: int) -> bool:
        if tolerance is None and trace is None:
            return False
        change = state.agg(F.sum("moved")).first()[0]
        if trace is not None:
            trace.append(change)
        return tolerance is not None and change < tolerance

    try:
        return iterate(deg.select("id", "deg", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved")), step, done, rounds).select("id", "rank")
    finally:
        kept.unpersist()
        release(deg)


def pagerank_blocked(edges: DataFrame, block: int, rounds: int = 19, tolerance: float | None = 0.001, dense: DataFrame | None = None) -> DataFrame:
    """pagerank over the densest column's edges and the residual edges, put together again."""
    y = graph.densest_column(edges, block)
    return pagerank(graph.residual_split(edges, block, y).unionAll(graph.column_split(edges, block, y)), rounds, tolerance, dense=dense)


def pagerank_errors(edges: DataFrame, rounds: int = 19, dense: DataFrame | None = None) -> DataFrame:
    """round, error: the sum of changes in each of `rounds` rounds."""
    trace: list[float] = []
    pagerank(edges, rounds, None, trace=trace, dense=dense)
    return edges.sparkSession.createDataFrame(list(enumerate(trace, 1)), "round bigint, error double")


def pagerank_fixed(edges: DataFrame, rounds: int, bits: int = 23, damping: float = DAMPING, dense: DataFrame | None = None, shifts: bool = True) -> DataFrame:
    """id, score: PageRank in integers scaled by 2^bits, with integer division by degree.

    A round's sum t is damped by (108 t) >> 7, or without `shifts` by damping * t, truncated.
    """
    deg = _with_out_degree(edges, dense)
    n = max(deg.count(), 1)
    kept, hubs = salted(edges.select("src", "dst"))
    scale = float(1 << bits)
    first, base = int(1.0 / n * scale), int((1.0 - damping) / n * scale)

    def step(state: DataFrame, _: int) -> DataFrame:
        share = state.where("deg > 0").select(F.col("id").alias("src"), F.call_function("div", "score", "deg").alias("share"))
        sums = kept.join(sent(share, hubs), ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        got = F.coalesce("got", F.lit(0).cast("bigint"))
        damped = F.shiftright(F.lit(FIXED_DAMPING) * got, FIXED_SHIFT) if shifts else (F.lit(damping) * got).cast("bigint")
        new = F.lit(base).cast("bigint") + damped
        return state.join(sums, "id", "left").select("id", "deg", new.alias("score"))

    try:
        return iterate(deg.select("id", "deg", F.lit(first).cast("bigint").alias("score")), step, lambda *_: False, rounds).select("id", "score")
    finally:
        kept.unpersist()
        release(deg)


def scatter_add(active: DataFrame, n: int, rounds: int = 101) -> DataFrame:
    """v, total for v in 0 .. n - 1: v, and v again for each time it is active in each round."""
    times = active.groupBy("v").agg(F.count(F.lit(1)).alias("times"))
    every = active.sparkSession.range(n).withColumnRenamed("id", "v")
    return every.join(times, "v", "left").select("v", (F.col("v") + rounds * F.col("v") * F.coalesce("times", F.lit(0))).alias("total"))


def strided_sum(values: DataFrame, base: int, num: int, stride: int, mask: int) -> DataFrame:
    """One row, the sum of values (addr, value) at (base + i * stride) & mask for i in 0 .. num - 1."""
    at = values.sparkSession.range(num).select((F.lit(base) + F.col("id") * stride).bitwiseAND(F.lit(mask).cast("bigint")).alias("addr"))
    read = at.groupBy("addr").agg(F.count(F.lit(1)).alias("times"))
    return values.join(read, "addr").agg(F.coalesce(F.sum(F.col("value") * F.col("times")), F.lit(0)).alias("total"))
