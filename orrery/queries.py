"""Every registered query of the join and graph operators, with DuckDB SQL for the same rows.

Relations: r has a row for each order (key o_orderkey), s one for each line item. Graphs are derived from line
items: all consecutive parts of an order. Every query runs over all of its tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scalar
from orrery.operators import algorithms, graph, joins
from orrery.operators.program import smallest_label
from orrery.plans import materialize
from orrery.plans.materialize import fresh_path
from orrery.sources import edges as edge_sources
from orrery.sources import relations

Query = Callable[[SparkSession, str], DataFrame]

BLOCK, BANKS, BUCKETS = 256, 32, 4096
FIXED_BITS, FIXED_ROUNDS, RANK_ROUNDS = 23, 10, 19

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("payload"))


def _s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("payload"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived edges, computed once."""
    return materialize(edge_sources.edges_from_lineitem(_read(spark, sf_dir, "lineitem")))


_RS = "r AS (SELECT o_orderkey AS key, o_custkey AS payload FROM orders), s AS (SELECT l_orderkey AS key, l_partkey AS payload FROM lineitem)"
_J = f"WITH {_RS}, j AS (SELECT s.key, s.payload AS s_payload, r.payload AS r_payload FROM s JOIN r USING (key))"
_ALL = """WITH RECURSIVE nxt AS (
  SELECT l_partkey AS src, CAST(l_quantity AS BIGINT) AS q,
         lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst
  FROM lineitem
), g AS (SELECT src, dst, count(*) AS mult, min(q) AS weight FROM nxt WHERE dst IS NOT NULL GROUP BY src, dst),
v AS (SELECT CAST(range AS BIGINT) AS id FROM range((SELECT greatest(max(src), max(dst)) + 1 FROM g)))"""

# --- joins ------------------------------------------------------------------------------------------


@_query("join_count", f"{_J} SELECT count(*) AS matches FROM j")
def join_count(spark, sf_dir):
    return joins.join_count(_r(spark, sf_dir), _s(spark, sf_dir))


@_query("join_count_preagg", f"{_J} SELECT count(*) AS matches FROM j")
def join_count_preagg(spark, sf_dir):
    return joins.join_count_preaggregated(_r(spark, sf_dir), _s(spark, sf_dir))


@_query("join_rows", f"{_J} SELECT key, s_payload, r_payload FROM j")
def join_rows(spark, sf_dir):
    return joins.join_rows(_r(spark, sf_dir), _s(spark, sf_dir))


@_query("join_count_asymmetric", "SELECT count(*) AS matches FROM (SELECT range + 1 AS key FROM range(2000)) JOIN (SELECT (range * 7919) % 20000 + 1 AS key FROM range(20000)) USING (key)")
def join_count_asymmetric(spark, sf_dir):
    return joins.join_count_preaggregated(relations.relation_pk(spark, 2000), relations.relation_permuted(spark, 20000))


def _lanes(lanes: int) -> None:
    @_query(f"join_lane_counts_{lanes}", f"{_J} SELECT key & {lanes - 1} AS lane, count(*) AS matches FROM j GROUP BY 1")
    def lane_counts(spark, sf_dir):
        return joins.lane_counts(_r(spark, sf_dir), _s(spark, sf_dir), lanes)


for _n in (4, 8, 16):
    _lanes(_n)


@_query("radix_histogram", f"WITH {_RS} SELECT (key & 16256) >> 7 AS part, count(*) AS rows FROM s GROUP BY 1")
def radix_histogram(spark, sf_dir):
    return joins.radix_histogram(_s(spark, sf_dir), 7, 7)


@_query("radix_partition_2pass", f"WITH {_RS} SELECT key & 16383 AS part, count(*) AS rows, min(key) AS least, max(key) AS most FROM s GROUP BY 1")
def radix_partition_2pass(spark, sf_dir):
    parts = joins.radix_partition(_s(spark, sf_dir), (7, 7))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("least"), F.max("key").alias("most"))


@_query(
    "partition_pairs_nonempty",
    f"WITH {_RS}, a AS (SELECT (key & 16256) >> 7 AS part, count(*) AS r_rows FROM r GROUP BY 1), b AS (SELECT (key & 16256) >> 7 AS part, count(*) AS s_rows FROM s GROUP BY 1) SELECT part, r_rows, s_rows FROM a JOIN b USING (part)",
)
def partition_pairs_nonempty(spark, sf_dir):
    """128 partitions by higher bits of the key, of which keys up to 14,999 leave the last ones empty."""
    return joins.pair_sizes(_r(spark, sf_dir), _s(spark, sf_dir), 7, 7)


@_query("join_count_bucketed", f"{_J} SELECT count(*) AS matches FROM j")
def join_count_bucketed(spark, sf_dir):
    """Both sides stored in equal buckets and joined where they lie."""
    names = [f"orrery_{side}_{uuid.uuid4().hex}" for side in "rs"]
    try:
        for name, rows in zip(names, (_r(spark, sf_dir), _s(spark, sf_dir)), strict=True):
            joins.write_bucketed(rows, name, 16)
        return materialize(joins.join_count_bucketed(spark, *names))
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@_query(
    "hash_table_buckets",
    f"WITH {_RS} SELECT key % {BUCKETS} AS bucket, row_number() OVER (PARTITION BY key % {BUCKETS} ORDER BY key, payload) - 1 AS slot, key, payload FROM r",
)
def hash_table_buckets(spark, sf_dir):
    return joins.hash_table(_r(spark, sf_dir), BUCKETS)


@_query(
    "hash_table_validate",
    f"WITH {_RS}, b AS (SELECT key % {BUCKETS} AS bucket, count(*) AS n FROM r GROUP BY 1) SELECT CAST(0 AS BIGINT) AS wrong_bucket, count(*) AS used_buckets, count(*) FILTER (n > 4) AS over_full, max(n) AS fullest, CAST(sum(n) AS BIGINT) AS rows FROM b",
)
def hash_table_validate(spark, sf_dir):
    return joins.hash_table_checks(joins.hash_table(_r(spark, sf_dir), BUCKETS), BUCKETS)


@_query(
    "skew_split_join",
    f"WITH {_RS}, t AS (SELECT key, CASE WHEN row_number() OVER (PARTITION BY key % 1024 ORDER BY key, payload) <= 4 THEN 'main' ELSE 'overflow' END AS part FROM r) SELECT part, count(*) AS matches FROM t JOIN s USING (key) GROUP BY part",
)
def skew_split_join(spark, sf_dir):
    return joins.skew_split_join(_r(spark, sf_dir), _s(spark, sf_dir), 1024)


@_query("relation_pk", "SELECT range + 1 AS key, range + 2 AS payload FROM range(10000)")
def relation_pk(spark, sf_dir):
    return relations.relation_pk(spark, 10000)


@_query("relation_permuted", "SELECT (range * 7919) % 10000 + 1 AS key, range + 2 AS payload FROM range(10000)")
def relation_permuted(spark, sf_dir):
    return relations.relation_permuted(spark, 10000)


@_query("relation_hashed", "SELECT ((((range & 2147483647) * 2654435761) & 4294967295) >> 16) % 256 * 10000 + range AS key, range + 2 AS payload FROM range(10000)")
def relation_hashed(spark, sf_dir):
    return relations.relation_hashed(spark, 10000)


@_query("relation_slice", "SELECT o_orderkey AS row_idx, o_custkey AS payload FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 600")
def relation_slice(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").alias("payload"))
    return relations.relation_slice(rows, 100, 500)


# --- scalars ----------------------------------------------------------------------------------------


def _keys(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))


@_query("scalar_radix", "SELECT o_orderkey AS k, (o_orderkey & 16256) >> 7 AS h, CAST((-7 & 16256) >> 7 AS BIGINT) AS negative FROM orders")
def scalar_radix(spark, sf_dir):
    return _keys(spark, sf_dir).select("k", scalar.radix_hash(F.col("k"), 16256, 7).alias("h"), scalar.radix_hash(F.lit(-7), 16256, 7).alias("negative"))


@_query("scalar_simhash", "SELECT o_orderkey AS k, ((o_orderkey - 1000) & 4294967295) % 1000 AS h FROM orders")
def scalar_simhash(spark, sf_dir):
    return _keys(spark, sf_dir).select("k", scalar.sim_hash(F.col("k") - 1000, 1000).alias("h"))


_DJB = "5381"
for _i in (0, 8, 16, 24):
    _DJB = f"({_DJB} * 33 + ((o_orderkey * 9973 >> {_i}) & 255))"


@_query("scalar_djb2", f"SELECT o_orderkey AS k, {_DJB} & 4294967295 AS h FROM orders")
def scalar_djb2(spark, sf_dir):
    return _keys(spark, sf_dir).select("k", scalar.djb2(F.col("k") * 9973).alias("h"))


@_query("scalar_next_pow2", "SELECT o_orderkey AS k, CAST(2 ** ceil(log2(o_orderkey + 1)) AS BIGINT) AS p FROM orders")
def scalar_next_pow2(spark, sf_dir):
    return _keys(spark, sf_dir).select("k", scalar.next_pow2(F.col("k") + 1).alias("p"))


@_query("scalar_align", "SELECT o_orderkey AS k, (o_orderkey // 16 + 1) * 16 AS a FROM orders")
def scalar_align(spark, sf_dir):
    return _keys(spark, sf_dir).select("k", scalar.align(F.col("k") + 1, 32, 512).alias("a"))


@_query("scalar_fixed", "SELECT o_orderkey AS k, CAST(trunc(1.0::DOUBLE / (o_orderkey + 1) * 8388608) AS BIGINT) AS f, CAST(trunc(1.0::DOUBLE / (o_orderkey + 1) * 8388608) AS BIGINT) / 8388608.0::DOUBLE AS back FROM orders")
def scalar_fixed(spark, sf_dir):
    fixed = scalar.to_fixed(F.lit(1.0) / (F.col("k") + 1), FIXED_BITS)
    return _keys(spark, sf_dir).select("k", fixed.alias("f"), scalar.from_fixed(fixed, FIXED_BITS).alias("back"))


@_query(
    "scalar_decode_mask",
    "SELECT range AS mask, CAST(bit_count(range) AS BIGINT) AS num, CAST(coalesce((SELECT sum(b << (3 * bit_count(m.range & ((1 << b) - 1)))) FROM (SELECT unnest([0,1,2,3,4,5,6,7])::BIGINT AS b) WHERE (m.range >> b) & 1 = 1), 0) AS BIGINT) AS idx FROM range(256) m",
)
def scalar_decode_mask(spark, sf_dir):
    m = F.col("id")
    return spark.range(256).select(m.alias("mask"), scalar.mask_count(m).cast("bigint").alias("num"), scalar.decode_mask(m).alias("idx"))


@_query("scalar_pairs", "SELECT l_partkey AS u, l_suppkey AS v, greatest(l_partkey, l_suppkey) AS high, least(l_partkey, l_suppkey) AS low, least(l_partkey + l_linenumber, l_suppkey) AS short, abs(l_partkey - l_suppkey) AS apart FROM lineitem")
def scalar_pairs(spark, sf_dir):
    u, v, w = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    high, low = scalar.high_low(u, v)
    return _read(spark, sf_dir, "lineitem").select(
        u.alias("u"), v.alias("v"), high.alias("high"), low.alias("low"), scalar.min_plus(u, w, v).alias("short"), F.abs(u - v).alias("apart")
    )


# --- graph preparation ------------------------------------------------------------------------------


@_query("edge_load", f"{_ALL} SELECT * FROM g")
def edge_load(spark, sf_dir):
    return edge_sources.edges_from_lineitem(_read(spark, sf_dir, "lineitem"))


@_query("edge_list_text", f"{_ALL} SELECT src, dst, weight FROM g")
def edge_list_text(spark, sf_dir):
    """The derived edges written as a text file and read back by the loader."""
    path = fresh_path(spark, "edges")
    _edges(spark, sf_dir).select(F.concat_ws(" \t", "src", "dst", "weight").alias("value")).write.text(path)
    return edge_sources.edge_list_text(spark, path)


@_query("edge_list_matrix_market", f"{_ALL} SELECT src, dst, weight FROM g")
def edge_list_matrix_market(spark, sf_dir):
    """The derived edges as a Matrix Market file, its comment and its line of sizes first, and back."""
    edges, path = _edges(spark, sf_dir), fresh_path(spark, "mtx")
    most = graph.id_bounds(edges).first()["max_id"] + 1
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate integer general"), (1, f"{most} {most} {edges.count()}")], "n int, value string")
    rows = head.unionByName(edges.select(F.lit(2).alias("n"), F.concat_ws(" ", "src", "dst", "weight").alias("value")))
    rows.coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return edge_sources.edge_list_text(spark, path, matrix_market=True)


@_query("named_graph", f"{_ALL} SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g WHERE src <> dst")
def named_graph(spark, sf_dir):
    """The derived edges stored below a base folder and loaded by the graph's name, both ways."""
    base = fresh_path(spark, "graphs")
    _edges(spark, sf_dir).select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).write.text(f"{base}/parts.txt")
    registry = edge_sources.GraphRegistry({"sim": base}, {"parts": edge_sources.NamedGraph("parts.txt", directed=False, start=0)})
    return registry.load(spark, "parts", "sim")


@_query("hashed_weights", f"{_ALL} SELECT src, dst, ((((((src & 2147483647) * 31 + (dst & 2147483647)) & 2147483647) * 2654435761) & 4294967295) >> 16) % 10 AS weight FROM g")
def hashed_weights(spark, sf_dir):
    return edge_sources.hashed_weights(_edges(spark, sf_dir).select("src", "dst"))


@_query("undirected_expand", f"{_ALL} SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g WHERE src <> dst")
def undirected_expand(spark, sf_dir):
    return edge_sources.undirected(_edges(spark, sf_dir).select("src", "dst"))


@_query("id_bounds", f"{_ALL} SELECT least(min(src), min(dst)) AS min_id, greatest(max(src), max(dst)) AS max_id FROM g")
def id_bounds(spark, sf_dir):
    return graph.id_bounds(_edges(spark, sf_dir))


_DEG = "od AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), ind AS (SELECT dst AS id, count(*) AS n FROM g GROUP BY 1), dg AS (SELECT v.id, coalesce(od.n, 0) AS out_deg, coalesce(ind.n, 0) AS in_deg FROM v LEFT JOIN od USING (id) LEFT JOIN ind USING (id))"


@_query("vertex_degrees", f"{_ALL}, {_DEG} SELECT * FROM dg")
def vertex_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@_query("csr_offsets", f"{_ALL}, {_DEG} SELECT id, out_deg AS deg, CAST(sum(out_deg) OVER (ORDER BY id) - out_deg AS BIGINT) AS row_ptr FROM dg")
def csr_offsets(spark, sf_dir):
    return graph.csr_offsets(_edges(spark, sf_dir))


@_query("csr_edges", f"{_ALL} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst FROM g")
def csr_edges(spark, sf_dir):
    return graph.csr_edges(_edges(spark, sf_dir))


@_query("adjacency_sorted", f"{_ALL} SELECT src AS id, array_to_string(list(dst ORDER BY dst), ',') AS neighbours FROM g GROUP BY src")
def adjacency_sorted(spark, sf_dir):
    lists = graph.adjacency(_edges(spark, sf_dir))
    return lists.select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@_query("adjacency_incoming", f"{_ALL} SELECT dst AS id, array_to_string(list(src ORDER BY src), ',') AS neighbours FROM g GROUP BY dst")
def adjacency_incoming(spark, sf_dir):
    lists = graph.adjacency(_edges(spark, sf_dir), "dst", "src")
    return lists.select("id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


_BLK = f"b AS (SELECT src // {BLOCK} AS blk_x, dst // {BLOCK} AS blk_y, count(*) AS cnt FROM g GROUP BY 1, 2)"
_SIDE = f"(SELECT max(id) // {BLOCK} + 1 FROM v)"
_DENSE = "(SELECT blk_y FROM b ORDER BY cnt DESC, blk_x, blk_y LIMIT 1)"


@_query("grid_blocks", f"{_ALL}, {_BLK} SELECT x.range AS blk_x, y.range AS blk_y, coalesce(cnt, 0) AS cnt FROM range({_SIDE}) x, range({_SIDE}) y LEFT JOIN b ON blk_x = x.range AND blk_y = y.range")
def grid_blocks(spark, sf_dir):
    return graph.grid_blocks(_edges(spark, sf_dir), BLOCK)


@_query("densest_block", f"{_ALL}, {_BLK} SELECT * FROM b ORDER BY cnt DESC, blk_x, blk_y LIMIT 1")
def densest_block(spark, sf_dir):
    return graph.densest_block(_edges(spark, sf_dir), BLOCK)


@_query("column_split", f"{_ALL}, {_BLK} SELECT g.* FROM g WHERE dst // {BLOCK} = {_DENSE}")
def column_split(spark, sf_dir):
    return graph.column_split(_edges(spark, sf_dir), BLOCK)


@_query("residual_split", f"{_ALL}, {_BLK} SELECT g.* FROM g WHERE dst // {BLOCK} <> {_DENSE}")
def residual_split(spark, sf_dir):
    return graph.residual_split(_edges(spark, sf_dir), BLOCK)


@_query(
    "partition_stats",
    f"{_ALL}, t AS (SELECT (SELECT count(*) FROM g) AS e, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v) * {_SIDE} AS bv) SELECT e AS edges, bv AS block_vertices, (e + bv) / (n + e) AS replication FROM t",
)
def partition_stats(spark, sf_dir):
    return graph.partition_stats(_edges(spark, sf_dir), BLOCK)


@_query("edge_share", f"{_ALL}, {_BLK} SELECT *, cnt / (SELECT count(*) FROM g) AS share FROM b")
def edge_share(spark, sf_dir):
    return graph.edge_share(_edges(spark, sf_dir), BLOCK)


@_query("edge_share_ascending", f"{_ALL}, {_BLK} SELECT *, cnt / (SELECT count(*) FROM g) AS share, row_number() OVER (ORDER BY cnt, blk_x, blk_y) - 1 AS pos FROM b")
def edge_share_ascending(spark, sf_dir):
    return graph.edge_share_ascending(_edges(spark, sf_dir), BLOCK)


_PAD = f"bins AS (SELECT src // {BLOCK} AS blk_x, dst // {BLOCK} AS blk_y, src, dst % {BANKS} AS bin, count(*) AS n FROM g GROUP BY ALL), pad AS (SELECT blk_x, blk_y, src, CAST(sum(n) AS BIGINT) AS edges, max(n) * {BANKS} AS padded FROM bins GROUP BY ALL)"


@_query("padding_size", f"{_ALL}, {_PAD} SELECT * FROM pad")
def padding_size(spark, sf_dir):
    return graph.padding_sizes(_edges(spark, sf_dir), BANKS, BLOCK)


@_query(
    "padding_layout",
    f"{_ALL}, f AS (SELECT src, dst % 4 AS bin, dst, row_number() OVER (PARTITION BY src, dst % 4 ORDER BY dst) - 1 AS slot FROM g), d AS (SELECT src, max(slot) AS deep FROM f GROUP BY src), c AS (SELECT src, slot, unnest(range(4)) AS bin FROM (SELECT src, unnest(range(deep + 1)) AS slot FROM d)) SELECT c.src, c.slot, c.bin, coalesce(dst, -1) AS dst FROM c LEFT JOIN f USING (src, slot, bin)",
)
def padding_layout(spark, sf_dir):
    return graph.padding_layout(_edges(spark, sf_dir), 4)


@_query("padding_stripped", f"{_ALL} SELECT src, dst FROM g")
def padding_stripped(spark, sf_dir):
    """The padded lists without their sentinels are the edges again."""
    return graph.padding_layout(_edges(spark, sf_dir), 4).where("dst <> -1").select("src", "dst")


@_query("replication_factor", f"{_ALL}, {_PAD} SELECT CAST(sum(edges) AS BIGINT) AS edges, CAST(sum(padded) AS BIGINT) AS padded, sum(padded) / sum(edges) AS factor FROM pad")
def replication_factor(spark, sf_dir):
    return graph.replication_factor(_edges(spark, sf_dir), BANKS, BLOCK)


@_query("degree_order", f"{_ALL}, {_DEG} SELECT row_number() OVER (ORDER BY out_deg DESC, id) - 1 AS pos, id, out_deg FROM dg")
def degree_order(spark, sf_dir):
    return graph.degree_order(_edges(spark, sf_dir))


@_query("degree_order_topk", f"{_ALL}, {_DEG} SELECT id, out_deg FROM dg ORDER BY out_deg DESC, id LIMIT 100")
def degree_order_topk(spark, sf_dir):
    return graph.top_degree(_edges(spark, sf_dir), 100)


@_query("hub_block_edges", f"{_ALL}, {_DEG}, h AS (SELECT id FROM dg ORDER BY out_deg DESC, id LIMIT {BLOCK}), i AS (SELECT dst // {BLOCK} AS y, count(*) AS n FROM g WHERE src IN (SELECT id FROM h) GROUP BY 1) SELECT max(n) AS most FROM i")
def hub_block_edges(spark, sf_dir):
    return graph.hub_block_edges(_edges(spark, sf_dir), BLOCK)


@_query("block_align", f"{_ALL}, {_BLK} SELECT blk_x, blk_y, cnt, ((cnt - 1) // 16 + 1) * 16 AS aligned FROM b")
def block_align(spark, sf_dir):
    return graph.block_counts(_edges(spark, sf_dir), BLOCK).withColumn("aligned", scalar.align(F.col("cnt"), 32, 512))


# --- searches ---------------------------------------------------------------------------------------


def _bfs_sql(base: str, source: str, depth: int) -> str:
    return f"{base}, w(id, depth) AS (SELECT CAST({source} AS BIGINT), CAST(0 AS BIGINT) UNION SELECT g.dst, w.depth + 1 FROM w JOIN g ON g.src = w.id WHERE w.depth < {depth}), d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), bfs AS (SELECT v.id, d.depth FROM v LEFT JOIN d USING (id))"


_BFS_ALL = _bfs_sql(_ALL, "0", 9)
_BFS_MIN = _bfs_sql(_ALL, "(SELECT min(src) FROM g)", 9)


def _source(edges: DataFrame) -> int:
    return edges.agg(F.min("src")).first()[0]


@_query("bfs_push", f"{_BFS_ALL} SELECT * FROM bfs")
def bfs_push(spark, sf_dir):
    return algorithms.bfs(_edges(spark, sf_dir), 0)


@_query("bfs_push_sparse", f"{_BFS_MIN} SELECT id, coalesce(depth, 2147483646) AS depth FROM bfs")
def bfs_push_sparse(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return algorithms.bfs(edges, _source(edges), unreached=2147483646)


@_query("bfs_pull", f"{_BFS_ALL} SELECT * FROM bfs")
def bfs_pull(spark, sf_dir):
    return algorithms.bfs_pull(_edges(spark, sf_dir), 0)


@_query("bfs_blocked", f"{_BFS_ALL} SELECT * FROM bfs")
def bfs_blocked(spark, sf_dir):
    return algorithms.bfs_blocked(_edges(spark, sf_dir), 0, BLOCK)


@_query("bfs_step", f"{_BFS_ALL} SELECT * FROM bfs WHERE depth = 2")
def bfs_step(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    first = spark.range(1).select("id", F.lit(0).cast("bigint").alias("depth"))
    second = first.union(materialize(algorithms.bfs_step(edges, first, 0)))
    return algorithms.bfs_step(edges, second, 1)


@_query("bfs_levels", f"{_BFS_MIN} SELECT depth, count(*) AS size FROM bfs WHERE depth IS NOT NULL GROUP BY depth")
def bfs_levels(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return algorithms.level_sizes(algorithms.bfs(edges, _source(edges)))


@_query("frontier_block", f"{_BFS_ALL} SELECT id, depth FROM bfs WHERE depth = 2 AND id // {BLOCK} = 0")
def frontier_block(spark, sf_dir):
    return graph.frontier_block(algorithms.bfs(_edges(spark, sf_dir), 0).where("depth = 2"), BLOCK, 0)


def _sssp_sql(base: str, rounds: int) -> str:
    sql = f"{base}, x0 AS MATERIALIZED (SELECT id, CASE WHEN id = 0 THEN 0::BIGINT END AS d FROM v)"
    for k in range(1, rounds + 1):
        sql += f", x{k} AS MATERIALIZED (SELECT p.id, least(p.d, m.d) AS d FROM x{k - 1} p LEFT JOIN (SELECT g.dst AS id, min(q.d + g.weight) AS d FROM x{k - 1} q JOIN g ON g.src = q.id WHERE q.d IS NOT NULL GROUP BY 1) m USING (id))"
    return f"{sql} SELECT id, d AS distance FROM x{rounds}"


@_query("sssp", _sssp_sql(_ALL, 24))
def sssp(spark, sf_dir):
    return algorithms.sssp(_edges(spark, sf_dir), 0)


def _cc_sql(base: str, rounds: int, end: str) -> str:
    sql = f"{base}, u AS MATERIALIZED (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), x0 AS MATERIALIZED (SELECT id, id AS c FROM v)"
    for k in range(1, rounds + 1):
        sql += f", x{k} AS MATERIALIZED (SELECT p.id, least(p.c, coalesce(m.c, p.c)) AS c FROM x{k - 1} p LEFT JOIN (SELECT u.b AS id, min(q.c) AS c FROM x{k - 1} q JOIN u ON u.a = q.id GROUP BY 1) m USING (id))"
    return f"{sql}, cc AS (SELECT id, c AS component FROM x{rounds}) {end}"


@_query("cc_labels", _cc_sql(_ALL, 24, "SELECT * FROM cc"))
def cc_labels(spark, sf_dir):
    return algorithms.connected_components(_edges(spark, sf_dir))


@_query("cc_sizes", _cc_sql(_ALL, 24, "SELECT component, count(*) AS size FROM cc GROUP BY 1"))
def cc_sizes(spark, sf_dir):
    return algorithms.component_sizes(algorithms.connected_components(_edges(spark, sf_dir)))


@_query("cc_count", _cc_sql(_ALL, 24, "SELECT count(DISTINCT component) AS components FROM cc"))
def cc_count(spark, sf_dir):
    sizes = algorithms.component_sizes(algorithms.connected_components(_edges(spark, sf_dir)))
    return sizes.agg(F.count(F.lit(1)).alias("components"))


@_query("vertex_program_labels", _cc_sql(_ALL, 24, "SELECT id, component AS value FROM cc"))
def vertex_program_labels(spark, sf_dir):
    """Components again, by a program of column expressions over undirected edges."""
    edges = _edges(spark, sf_dir)
    first = graph.vertices(edges).select("id", F.col("id").alias("value"), F.lit(True).alias("active"))
    return smallest_label().run(edge_sources.undirected(edges.select("src", "dst")), first)


# --- PageRank ---------------------------------------------------------------------------------------


def _rank_sql(base: str, rounds: int, end: str, errors: bool = False) -> str:
    sql = f"{base}, dg AS MATERIALIZED (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v), x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT n FROM c) AS r FROM v)"
    for k in range(1, rounds + 1):
        sql += f", x{k} AS MATERIALIZED (SELECT p.id, (1 - 0.85::DOUBLE) / (SELECT n FROM c) + 0.85::DOUBLE * coalesce(m.s, 0) AS r FROM x{k - 1} p LEFT JOIN (SELECT g.dst AS id, sum(q.r / dg.n) AS s FROM x{k - 1} q JOIN g ON g.src = q.id JOIN dg ON dg.id = q.id GROUP BY 1) m USING (id))"
    return f"{sql} {end}"


@_query("pagerank", _rank_sql(_ALL, RANK_ROUNDS, f"SELECT id, round(r, 9) AS rank FROM x{RANK_ROUNDS}"))
def pagerank(spark, sf_dir):
    return algorithms.pagerank(_edges(spark, sf_dir), RANK_ROUNDS, None).select("id", F.round("rank", 9).alias("rank"))


TOLERANCE = 0.001


def _converged_sql(rounds: int) -> str:
    errors = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(abs(a.r - b.r)) FROM x{k} a JOIN x{k - 1} b USING (id)) AS e" for k in range(1, rounds + 1))
    states = " UNION ALL ".join(f"SELECT {k} AS k, id, r FROM x{k}" for k in range(1, rounds + 1))
    return _rank_sql(_ALL, rounds, f", er AS ({errors}), st AS ({states}) SELECT id, round(r, 9) AS rank FROM st WHERE k = (SELECT coalesce(min(k), {rounds}) FROM er WHERE e < {TOLERANCE}::DOUBLE)")


@_query("pagerank_converged", _converged_sql(RANK_ROUNDS))
def pagerank_converged(spark, sf_dir):
    """Stops once the ranks change by less than TOLERANCE in sum, before the last round."""
    return algorithms.pagerank(_edges(spark, sf_dir), RANK_ROUNDS, TOLERANCE).select("id", F.round("rank", 9).alias("rank"))


@_query("pagerank_blocked", _rank_sql(_ALL, RANK_ROUNDS, f"SELECT id, round(r, 9) AS rank FROM x{RANK_ROUNDS}"))
def pagerank_blocked(spark, sf_dir):
    return algorithms.pagerank_blocked(_edges(spark, sf_dir), BLOCK, RANK_ROUNDS, None).select("id", F.round("rank", 9).alias("rank"))


_ERRORS = " UNION ALL ".join(f"SELECT {k} AS round, round((SELECT sum(abs(a.r - b.r)) FROM x{k} a JOIN x{k - 1} b USING (id)), 9) AS error" for k in range(1, 6))


@_query("pagerank_error_trace", _rank_sql(_ALL, 5, f"SELECT CAST(round AS BIGINT) AS round, error FROM ({_ERRORS})"))
def pagerank_error_trace(spark, sf_dir):
    return algorithms.pagerank_errors(_edges(spark, sf_dir), 5).select("round", F.round("error", 9).alias("error"))


def _fixed_sql(base: str, rounds: int, bits: int, damped: str) -> str:
    one = f"CAST(trunc(1.0::DOUBLE / (SELECT n FROM c) * {1 << bits}) AS BIGINT)"
    low = f"CAST(trunc((1 - 0.85::DOUBLE) / (SELECT n FROM c) * {1 << bits}) AS BIGINT)"
    sql = f"{base}, dg AS MATERIALIZED (SELECT src AS id, count(*) AS n FROM g GROUP BY 1), c AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v), x0 AS MATERIALIZED (SELECT id, {one} AS r FROM v)"
    for k in range(1, rounds + 1):
        sql += f", x{k} AS MATERIALIZED (SELECT p.id, {low} + {damped} AS r FROM x{k - 1} p LEFT JOIN (SELECT g.dst AS id, CAST(sum(q.r // dg.n) AS BIGINT) AS s FROM x{k - 1} q JOIN g ON g.src = q.id JOIN dg ON dg.id = q.id GROUP BY 1) m USING (id))"
    return f"{sql} SELECT id, r AS score FROM x{rounds}"


_SHIFTED, _TRUNCATED = "((108 * coalesce(m.s, 0)) >> 7)", "CAST(trunc(0.85::DOUBLE * coalesce(m.s, 0)) AS BIGINT)"


@_query("pagerank_fixed", _fixed_sql(_ALL, FIXED_ROUNDS, FIXED_BITS, _SHIFTED))
def pagerank_fixed(spark, sf_dir):
    return algorithms.pagerank_fixed(_edges(spark, sf_dir), FIXED_ROUNDS, FIXED_BITS)


@_query("pagerank_fixed_28", _fixed_sql(_ALL, 3, 28, _SHIFTED))
def pagerank_fixed_28(spark, sf_dir):
    return algorithms.pagerank_fixed(_edges(spark, sf_dir), 3, 28)


@_query("pagerank_fixed_truncated", _fixed_sql(_ALL, 3, FIXED_BITS, _TRUNCATED))
def pagerank_fixed_truncated(spark, sf_dir):
    return algorithms.pagerank_fixed(_edges(spark, sf_dir), 3, FIXED_BITS, shifts=False)


# --- memory benchmarks ------------------------------------------------------------------------------


@_query("scatter_add", "WITH a AS (SELECT l_partkey % 4096 AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT range AS v, range + 101 * range * coalesce(n, 0) AS total FROM range(4096) LEFT JOIN a ON v = range")
def scatter_add(spark, sf_dir):
    active = _read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 4096).alias("v"))
    return algorithms.scatter_add(active, 4096)


@_query("scatter_add_generated", "WITH a AS (SELECT ((((range & 2147483647) * 2654435761) & 4294967295) >> 8) % 1024 AS v, count(*) AS n FROM range(4096) GROUP BY 1) SELECT range AS v, range + 101 * range * coalesce(n, 0) AS total FROM range(1024) LEFT JOIN a ON v = range")
def scatter_add_generated(spark, sf_dir):
    """The benchmark's own input: pseudo-random active vertices."""
    return algorithms.scatter_add(relations.active_vertices(spark, 1024, 4), 1024)


@_query("strided_sum", "SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM (SELECT (5 + range * 128) & 1023 AS addr FROM range(100000)) JOIN orders ON o_orderkey = addr")
def strided_sum(spark, sf_dir):
    values = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("addr"), F.col("o_custkey").alias("value"))
    return algorithms.strided_sum(values, 5, 100000, 128, 1023)
