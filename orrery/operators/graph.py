"""Relational operators on graphs: edges(src, dst, ...), vertices 0 .. largest id, isolated ones included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans import ranked, running_sum


def whole(edges: DataFrame) -> DataFrame:
    """The edges with both ends; one with a NULL end is no edge, here and in every operator."""
    return edges.where("src is not null and dst is not null")


def id_bounds(edges: DataFrame) -> DataFrame:
    """One row: min_id and max_id over both ends."""
    return whole(edges).agg(F.least(F.min("src"), F.min("dst")).alias("min_id"), F.greatest(F.max("src"), F.max("dst")).alias("max_id"))


def vertices(edges: DataFrame) -> DataFrame:
    """id: 0 .. largest id."""
    most = id_bounds(edges).first()["max_id"]
    return edges.sparkSession.range(0 if most is None else most + 1)


def degrees(edges: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """id, out_deg, in_deg of every vertex; repeated edges count each.

    Both ends of an edge are counted in one aggregation, so edges are read and shuffled once.
    """
    ends = whole(edges).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e"))
    n = ends.groupBy("e.id").agg(F.sum("e.o").alias("out_deg"), F.sum(1 - F.col("e.o")).alias("in_deg"))
    every = vertices(edges) if dense is None else dense
    return every.join(n, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("out_deg", "in_deg")])


def adjacency(edges: DataFrame, by: str = "src", other: str = "dst") -> DataFrame:
    """id, neighbours (ascending, repeated edges kept) of every vertex that has any."""
    return whole(edges).groupBy(F.col(by).alias("id")).agg(F.sort_array(F.collect_list(other)).alias("neighbours"))


def csr_offsets(edges: DataFrame) -> DataFrame:
    """id, deg, row_ptr: the out-degrees' exclusive prefix sum in id order."""
    deg = degrees(edges).select("id", F.col("out_deg").alias("deg"))
    return running_sum(deg, ["id"], "deg", "row_ptr")


def csr_edges(edges: DataFrame) -> DataFrame:
    """pos, src, dst: edges in (src, dst) order, numbered from 0."""
    return ranked(whole(edges).select("src", "dst"), ["src", "dst"], out="pos")


def with_blocks(edges: DataFrame, block: int) -> DataFrame:
    """edges with blk_x = src div block and blk_y = dst div block."""
    cells = [F.floor(F.col(c) / block).cast("bigint").alias(n) for c, n in (("src", "blk_x"), ("dst", "blk_y"))]
    return whole(edges).select("*", *cells)


def block_counts(edges: DataFrame, block: int) -> DataFrame:
    """blk_x, blk_y, cnt of the blocks that have edges."""
    return with_blocks(edges, block).groupBy("blk_x", "blk_y").agg(F.count(F.lit(1)).alias("cnt"))


def grid_blocks(edges: DataFrame, block: int) -> DataFrame:
    """blk_x, blk_y, cnt of every block of the grid, empty ones with 0."""
    side = _side(edges, block)
    cells = edges.sparkSession.range(side * side).select(F.floor(F.col("id") / side).alias("blk_x"), (F.col("id") % side).alias("blk_y"))
    return cells.join(block_counts(edges, block), ["blk_x", "blk_y"], "left").select("blk_x", "blk_y", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def _side(edges: DataFrame, block: int) -> int:
    """Blocks in a row of the grid; none without edges."""
    most = id_bounds(edges).first()["max_id"]
    return 0 if most is None else most // block + 1


def densest_block(edges: DataFrame, block: int) -> DataFrame:
    """The block with most edges; of several the first in x, then y."""
    return block_counts(edges, block).orderBy(F.desc("cnt"), "blk_x", "blk_y").limit(1)


def densest_column(edges: DataFrame, block: int) -> int:
    """blk_y of the densest block; 0 without edges."""
    most = densest_block(edges, block).first()
    return most["blk_y"] if most else 0


def column_split(edges: DataFrame, block: int, column: int | None = None) -> DataFrame:
    """Edges into one column of blocks, by default the densest block's."""
    y = densest_column(edges, block) if column is None else column
    return whole(edges).where((F.col("dst") >= y * block) & (F.col("dst") < (y + 1) * block))


def residual_split(edges: DataFrame, block: int, column: int | None = None) -> DataFrame:
    """All other edges; with column_split they are all edges, each once."""
    y = densest_column(edges, block) if column is None else column
    return whole(edges).where((F.col("dst") < y * block) | (F.col("dst") >= (y + 1) * block))


def partition_stats(edges: DataFrame, block: int) -> DataFrame:
    """One row: edges, vertices summed over blocks (their source ranges), replication (sum e + sum v) / (v + sum e)."""
    n, side = vertices(edges).count(), _side(edges, block)
    total = n * side  # every block of a row of the grid counts that row's sources
    return whole(edges).agg(F.count(F.lit(1)).alias("edges")).select(
        "edges",
        F.lit(total).cast("bigint").alias("block_vertices"),
        F.try_divide(F.col("edges") + total, F.lit(n) + F.col("edges")).alias("replication"),
    )


def edge_share(edges: DataFrame, block: int) -> DataFrame:
    """blk_x, blk_y, cnt and the block's share of all edges."""
    total = whole(edges).count()
    return block_counts(edges, block).withColumn("share", F.col("cnt") / F.lit(max(total, 1)))


def edge_share_ascending(edges: DataFrame, block: int) -> DataFrame:
    """edge_share with pos: the blocks' places by share, the least first, then by x and y."""
    return ranked(edge_share(edges, block), ["cnt", "blk_x", "blk_y"], out="pos")


def _bins(edges: DataFrame, k: int, block: int | None) -> tuple[DataFrame, list[str]]:
    rows = with_blocks(edges, block) if block else whole(edges)
    keys = ["blk_x", "blk_y", "src"] if block else ["src"]
    return rows.select(*keys, "dst", F.pmod("dst", F.lit(k)).alias("bin")), keys


def padding_sizes(edges: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """For each source (and block): its edges, and padded = k times its fullest of k bins of neighbours by dst mod k."""
    rows, keys = _bins(edges, k, block)
    per = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("edges"), (F.max("n") * k).alias("padded"))


def padding_layout(edges: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """src (and block), slot, bin, dst: the padded neighbour lists, -1 where a bin is short."""
    rows, keys = _bins(edges, k, block)
    slot = F.row_number().over(W.partitionBy(*keys, "bin").orderBy("dst")) - 1
    filled = rows.withColumn("slot", slot)
    depth = filled.groupBy(*keys).agg(F.max("slot").alias("deep"))
    cells = depth.select(*keys, F.explode(F.sequence(F.lit(0), F.col("deep"))).alias("slot")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("bin"))
    dst = F.coalesce("dst", F.lit(-1)).alias("dst")
    return cells.join(filled, [*keys, "slot", "bin"], "left").select(*keys, F.col("slot").cast("bigint").alias("slot"), F.col("bin").cast("bigint").alias("bin"), dst)


def replication_factor(edges: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """One row: edges, padded edges and their ratio."""
    total = padding_sizes(edges, k, block).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum("padded"), F.lit(0)).alias("padded"))
    return total.withColumn("factor", F.when(F.col("edges") > 0, F.col("padded") / F.col("edges")))


def degree_order(edges: DataFrame) -> DataFrame:
    """pos, id, out_deg: vertices by descending out-degree, then id, numbered from 0."""
    return ranked(degrees(edges).select("id", "out_deg"), [F.col("out_deg").desc(), F.col("id").asc()], out="pos")


def top_degree(edges: DataFrame, k: int) -> DataFrame:
    """The k vertices that degree_order puts first."""
    return degrees(edges).select("id", "out_deg").orderBy(F.desc("out_deg"), "id").limit(k)


def hub_block_edges(edges: DataFrame, block: int) -> DataFrame:
    """One row, the most edges from the `block` vertices of highest degree into one block of sinks."""
    hubs = top_degree(edges, block).select(F.col("id").alias("src"))
    into = whole(edges).join(hubs, "src", "left_semi").groupBy(F.floor(F.col("dst") / block).alias("blk_y")).agg(F.count(F.lit(1)).alias("n"))
    return into.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def frontier_block(frontier: DataFrame, block: int, x: int) -> DataFrame:
    """The vertices of a frontier in block x."""
    return frontier.where((F.col("id") >= x * block) & (F.col("id") < (x + 1) * block))
