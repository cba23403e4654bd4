import pytest

from orrery.operators import joins
from orrery.sources import relations


def rel(spark, keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key bigint, payload bigint")


CASES = {
    "dup": ([1, 1, 1, 2, 5], [1, 1, 2, 3, 5, 5], 9),
    "hot_bucket": ([1, 17, 33, 49, 65, 81], [1, 17, 33, 49, 65, 81], 6),
    "disjoint": ([1, 2, 3, 4], [100, 101], 0),
    "null_key": ([1, None], [1, None], 1),
    "empty": ([], [1, 2], 0),
}


@pytest.mark.parametrize("name", CASES)
def test_counts_agree(spark, name):
    r_keys, s_keys, want = CASES[name]
    r, s = rel(spark, r_keys), rel(spark, s_keys)
    assert joins.join_count(r, s).first()["matches"] == want
    assert joins.join_count_preaggregated(r, s).first()["matches"] == want
    assert joins.join_rows(r, s).count() == want
    for lanes in (4, 16):
        assert sum(x["matches"] for x in joins.lane_counts(r, s, lanes).collect()) == want
    assert sum(x["matches"] for x in joins.skew_split_join(r, s, 16).collect()) == want


def test_primary_keys(spark):
    r = relations.relation_pk(spark, 8)
    s = relations.relation_permuted(spark, 80)
    assert joins.join_count(r, s).first()["matches"] == 8
    assert {x["key"] for x in s.collect()} == set(range(1, 81))


def test_hot_bucket_overflows(spark):
    r = rel(spark, CASES["hot_bucket"][0])
    table = joins.hash_table(r, 16)
    assert sorted((x["bucket"], x["slot"]) for x in table.collect()) == [(1, i) for i in range(6)]
    assert joins.hash_table_checks(table, 16).first().asDict() == {"wrong_bucket": 0, "used_buckets": 1, "over_full": 1, "fullest": 6, "rows": 6}
    parts = {x["part"]: x["matches"] for x in joins.skew_split_join(r, r, 16).collect()}
    assert parts == {"main": 4, "overflow": 2}


def test_passes_make_one_partition(spark):
    r = relations.relation_pk(spark, 1000)
    two = joins.radix_partition(r, (3, 4)).select("key", "part").collect()
    assert all(x["part"] == x["key"] & 127 for x in two)
    assert sum(x["rows"] for x in joins.radix_histogram(r, 7).collect()) == 1000


def test_empty_partitions_are_skipped(spark):
    got = joins.pair_sizes(rel(spark, [0, 16, 1]), rel(spark, [0, 2]), 4).collect()
    assert [tuple(x) for x in got] == [(0, 2, 1)]


def test_preaggregated_plan_shuffles_counts(spark):
    r, s = rel(spark, [1, 2]), rel(spark, [1, 1])
    plan = joins.join_count_preaggregated(r, s)._jdf.queryExecution().toString()
    assert "partial_count" in plan


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.sql("DROP TABLE IF EXISTS bucketed_r")
    joins.write_bucketed(relations.relation_pk(spark, 100), "bucketed_r", 4)
    t = spark.table("bucketed_r")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t.alias("a").join(t.alias("b"), "key").select("key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE bucketed_r")
    assert "Exchange hashpartitioning" not in plan


def test_slice_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "row_idx").write.parquet(str(tmp_path / "r"))
    cut = relations.relation_slice(spark.read.parquet(str(tmp_path / "r")), 10, 5)
    assert cut.count() == 5
    assert "GreaterThanOrEqual(row_idx,10)" in cut._jdf.queryExecution().toString()
