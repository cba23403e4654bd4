import datetime as dt

from orrery.operators import graph
from orrery.streaming.degrees import EDGE_SCHEMA, edge_stream, stream_degrees, stream_edge_rates


def test_streamed_degrees_equal_batch_degrees(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    for k, part in enumerate([[(0, 1, at), (0, 2, at)], [(2, 1, at), (2, 2, at), (None, 1, at)]]):
        spark.createDataFrame(part, EDGE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = str(tmp_path / "in" / "*")
    query = stream_degrees(edge_stream(spark, source, files_per_trigger=1)).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    query.processAllAvailable()
    query.stop()
    got = {r["id"]: (r["out_deg"], r["in_deg"]) for r in spark.table("degrees").collect()}
    batch = spark.read.schema(EDGE_SCHEMA).parquet(source).where("src is not null")
    assert got == {r["id"]: (r["out_deg"], r["in_deg"]) for r in graph.degrees(batch).collect()}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(0, 1, at), (0, 2, at), (1, 2, at + dt.timedelta(hours=1))]
    spark.createDataFrame(rows, EDGE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream_edge_rates(edge_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("rates").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["src"], r["n"]) for r in spark.table("rates").collect()] == [(0, 2)]
