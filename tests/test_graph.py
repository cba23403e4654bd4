import pytest
from pyspark.sql import functions as F

from orrery.operators import algorithms, graph
from orrery.operators.components import components
from orrery.operators.program import smallest_label
from orrery.plans import materialize, ranked, release, running_sum, salted, sweep
from orrery.sources.edges import undirected

EDGES = [(0, 1, 4), (0, 2, 1), (2, 1, 2), (1, 3, 1), (3, 0, 7), (2, 4, 5), (4, 4, 1), (5, 6, 3)]


@pytest.fixture(scope="module")
def tiny(spark):
    """Eight edges over 0 .. 6."""
    return spark.createDataFrame(EDGES, "src bigint, dst bigint, weight bigint").cache()


@pytest.fixture(scope="module")
def dense8(spark):
    return spark.range(8)


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_degrees(tiny, dense8):
    got = graph.degrees(tiny, dense8)
    assert [values(got, "out_deg")[i] for i in range(8)] == [2, 1, 2, 1, 1, 1, 0, 0]
    assert sum(values(got, "in_deg").values()) == len(EDGES)


def test_offsets(tiny):
    got = values(graph.csr_offsets(tiny), "row_ptr")
    assert [got[i] for i in range(7)] == [0, 2, 3, 5, 6, 7, 8]
    assert [(r["src"], r["dst"]) for r in graph.csr_edges(tiny).orderBy("pos").collect()] == sorted(e[:2] for e in EDGES)


def test_bfs_forms_agree(tiny):
    want = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: None, 6: None}
    assert values(algorithms.bfs(tiny, 0), "depth") == want
    assert values(algorithms.bfs_pull(tiny, 0), "depth") == want
    assert values(algorithms.bfs_blocked(tiny, 0, 2), "depth") == want
    assert values(algorithms.bfs(tiny, 0, unreached=99), "depth")[5] == 99
    unit = tiny.withColumn("weight", F.lit(1).cast("bigint"))
    assert values(algorithms.sssp(unit, 0), "distance") == want
    assert sorted(tuple(r) for r in algorithms.level_sizes(algorithms.bfs(tiny, 0)).collect()) == [(0, 1), (1, 2), (2, 2)]


def test_sssp(tiny):
    assert values(algorithms.sssp(tiny, 0), "distance") == {0: 0, 1: 3, 2: 1, 3: 4, 4: 6, 5: None, 6: None}


def test_components(spark, tiny):
    got = values(algorithms.connected_components(tiny), "component")
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5}
    first = graph.vertices(tiny).select("id", F.col("id").alias("value"), F.lit(True).alias("active"))
    assert values(smallest_label().run(undirected(tiny.select("src", "dst")), first), "value") == got
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).collect() == []
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    star = spark.range(1000, 1200).select(F.lit(999).cast("bigint").alias("src"), F.col("id").alias("dst"))
    got = values(components(path.union(star)), "component")
    assert {got[i] for i in range(201)} == {0}
    assert {got[i] for i in range(999, 1200)} == {999}


def test_isolated_vertices(tiny, dense8):
    assert values(algorithms.bfs(tiny, 0, dense=dense8), "depth") == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: None, 6: None, 7: None}
    assert values(algorithms.bfs_pull(tiny, 0, dense=dense8), "depth")[7] is None
    assert values(algorithms.sssp(tiny, 0, dense=dense8), "distance")[7] is None
    assert values(algorithms.connected_components(tiny, dense8), "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5, 7: 7}


RANKS = {
    1: [0.125, 0.125, 0.071875, 0.125, 0.178125, 0.01875, 0.125, 0.01875],
    2: [0.125, 0.102421875, 0.071875, 0.125, 0.200703125, 0.01875, 0.0346875, 0.01875],
    3: [0.125, 0.102421875, 0.071875, 0.105808594, 0.219894531, 0.01875, 0.0346875, 0.01875],
}


@pytest.mark.parametrize("rounds", RANKS)
def test_pagerank_drops_dangling_mass(tiny, dense8, rounds):
    got = values(algorithms.pagerank(tiny, rounds, None, dense=dense8), "rank")
    assert [got[i] for i in range(8)] == pytest.approx(RANKS[rounds], abs=1e-9)
    blocked = values(algorithms.pagerank_blocked(tiny, 2, rounds, None, dense=dense8), "rank")
    assert [blocked[i] for i in range(8)] == pytest.approx(RANKS[rounds], abs=1e-9)


def test_pagerank_errors(tiny, dense8):
    errors = [r["error"] for r in algorithms.pagerank_errors(tiny, 2, dense=dense8).orderBy("round").collect()]
    assert errors == pytest.approx([0.31875, 0.13546875])


def test_pagerank_fixed(tiny, dense8):
    one = values(algorithms.pagerank_fixed(tiny, 1, dense=dense8), "score")
    assert [one[i] for i in range(8)] == [1042022, 1042022, 599654, 1042022, 1484390, 157286, 1042022, 157286]
    two = values(algorithms.pagerank_fixed(tiny, 2, dense=dense8), "score")
    assert [two[i] for i in range(8)] == [1036492, 849868, 596889, 1036492, 1662719, 157286, 289996, 157286]


def test_padding(tiny):
    assert graph.replication_factor(tiny, 2).first()["padded"] == 12
    assert graph.replication_factor(tiny, 4).first()["padded"] == 24
    layout = graph.padding_layout(tiny, 4)
    assert layout.count() == 24
    assert sorted((r["src"], r["dst"]) for r in layout.where("dst <> -1").collect()) == sorted(e[:2] for e in EDGES)


def test_blocks(tiny):
    assert graph.grid_blocks(tiny, 2).agg(F.sum("cnt")).first()[0] == len(EDGES)
    assert graph.grid_blocks(tiny, 2).count() == 16
    column, residual = graph.column_split(tiny, 2), graph.residual_split(tiny, 2)
    assert sorted(map(tuple, column.union(residual).collect())) == sorted(EDGES)
    share = graph.edge_share(tiny, 2).agg(F.sum("share")).first()[0]
    assert abs(share - 1) < 1e-12


def test_degree_order(tiny):
    assert [r["id"] for r in graph.degree_order(tiny).orderBy("pos").collect()] == [0, 2, 1, 3, 4, 5, 6]
    assert [r["id"] for r in graph.top_degree(tiny, 2).collect()] == [0, 2]


def test_ranks_and_sums(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 AS g")
    assert all(r["rank"] == r["id"] // 3 for r in ranked(rows, ["id"], ["g"], partitions=5).collect())
    assert all(r["before"] == r["id"] * (r["id"] - 1) // 2 for r in running_sum(rows, ["id"], "id", "before").collect())


def test_scatter_and_strides(spark):
    active = spark.createDataFrame([(1,), (1,), (3,)], "v bigint")
    assert {r["v"]: r["total"] for r in algorithms.scatter_add(active, 4, 101).collect()} == {0: 0, 1: 203, 2: 2, 3: 306}
    memory = spark.range(16).select(F.col("id").alias("addr"), (F.col("id") * 10).alias("value"))
    assert algorithms.strided_sum(memory, 1, 10, 5, 15).first()["total"] == sum(((1 + 5 * i) & 15) * 10 for i in range(10))


def test_tables_are_released_and_swept(spark, tmp_path):
    table = materialize(spark.range(5))
    assert table.count() == 5
    other = materialize(table.where("id > 2"))
    release(table)
    assert other.count() == 2
    assert sweep(spark) >= 1
    assert sweep(spark) == 0


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint, weight bigint")
    for f in (graph.grid_blocks, graph.column_split, graph.residual_split, graph.edge_share, graph.edge_share_ascending, graph.densest_block):
        assert f(none, 2).collect() == []
    stats = graph.partition_stats(none, 2).first()
    assert (stats["edges"], stats["block_vertices"], stats["replication"]) == (0, 0, None)
    assert algorithms.pagerank_blocked(none, 2).collect() == algorithms.pagerank_fixed(none, 2).collect() == []
    assert graph.degree_order(none).collect() == graph.csr_edges(none).collect() == graph.adjacency(none).collect() == []
    assert graph.replication_factor(none, 2).first()["edges"] == 0


def test_edges_with_a_null_end_are_none(spark):
    edges = spark.createDataFrame([(0, 1, 1), (None, 1, 1), (1, None, 1), (None, None, 1)], "src bigint, dst bigint, weight bigint")
    plain = edges.where("src = 0")
    for f in (graph.degrees, graph.adjacency, graph.csr_edges, graph.csr_offsets, graph.vertices, algorithms.connected_components, algorithms.pagerank):
        assert sorted(map(str, f(edges).collect())) == sorted(map(str, f(plain).collect())), f.__name__
    for f in (graph.block_counts, graph.grid_blocks, graph.partition_stats, graph.edge_share, graph.padding_sizes, graph.padding_layout, graph.column_split):
        assert sorted(map(str, f(edges, 2).collect())) == sorted(map(str, f(plain, 2).collect())), f.__name__
    for f in (algorithms.bfs, algorithms.bfs_pull, algorithms.sssp):
        assert sorted(map(str, f(edges, 0).collect())) == sorted(map(str, f(plain, 0).collect())), f.__name__


def test_hubs_are_dealt_over_salts(spark, monkeypatch):
    """A vertex of many edges is parted, and nothing else changes."""
    star = spark.range(1, 200).selectExpr("0 AS src", "id AS dst", "id % 7 AS weight").union(spark.range(1, 200).selectExpr("id", "(id * 17) % 200", "1"))
    want = [sorted(map(str, f(star).collect())) for f in (lambda e: algorithms.pagerank(e).select("id", F.round("rank", 9)), lambda e: algorithms.bfs(e, 3), lambda e: algorithms.sssp(e, 3))]
    monkeypatch.setattr(salted, "__defaults__", (10,))
    kept, hubs = salted(star.select("src", "dst"))
    assert hubs.count() == 19 and kept.groupBy("src", "salt").count().agg(F.max("count")).first()[0] < 30
    after = [sorted(map(str, f(star).collect())) for f in (lambda e: algorithms.pagerank(e).select("id", F.round("rank", 9)), lambda e: algorithms.bfs(e, 3), lambda e: algorithms.sssp(e, 3))]
    assert after == want


def test_convergence_stops_early(tiny, dense8):
    """The ranks of the first round whose change is below the tolerance, not of the last."""
    trace = []
    got = values(algorithms.pagerank(tiny, 19, 0.1, trace=trace, dense=dense8), "rank")
    assert len(trace) == 3 and trace[1] >= 0.1 > trace[2]
    assert [got[i] for i in range(8)] == pytest.approx(RANKS[3], abs=1e-9)


def test_fixed_point_variants(tiny, dense8):
    one = values(algorithms.pagerank_fixed(tiny, 1, dense=dense8, shifts=False), "score")
    first, base = int(2**23 / 8), int((1 - 0.85) / 8 * 2**23)
    assert [one[i] for i in (0, 2, 5, 7)] == [base + int(0.85 * first), base + int(0.85 * (first // 2)), base, base]
    big = values(algorithms.pagerank_fixed(tiny, 1, 28, dense=dense8), "score")
    assert big[0] == int((1 - 0.85) / 8 * 2**28) + (108 * (2**28 // 8) >> 7)
