"""An optional extension: degrees of a growing edge list, kept up to date by a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src bigint, dst bigint, ts timestamp"


def edge_stream(spark: SparkSession, path: str, schema: str = EDGE_SCHEMA, files_per_trigger: int = 64) -> DataFrame:
    """Edges from the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_degrees(edges: DataFrame) -> DataFrame:
    """id, out_deg, in_deg so far (update or complete mode); state grows with vertices, not edges."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    e = edges.where("src is not null and dst is not null").select(F.explode(ends).alias("e"))
    return e.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("out_deg"), F.sum("e.i").alias("in_deg"))


def stream_edge_rates(edges: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """window, src, n: edges of each source in each window of event time, final once the watermark has passed."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", every), "src").agg(F.count(F.lit(1)).alias("n"))
