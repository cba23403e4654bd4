"""Edge lists: text files, named graphs, and edges derived from line items."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.plans import materialize


def edge_list_text(spark: SparkSession, path: str, matrix_market: bool = False) -> DataFrame:
    """src, dst and weight (third column, null if there is none) of a file of white-space-separated integers.

    Blank lines, lines that begin with # or %, and lines without two integers are skipped; with
    `matrix_market` the line of sizes, the first of each file that is no comment, is skipped too. Files are read in
    splits, so a file's first line is found by its split's offset and its place there, not by its text.
    """
    kept = [F.trim(F.translate("value", "\t\r", "  ")).alias("line")]
    where = ["_metadata.file_path AS file", "_metadata.file_block_start AS begin", "monotonically_increasing_id() AS at"] if matrix_market else []
    lines = spark.read.text(path).select(*kept, *map(F.expr, where))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("%"))
    if matrix_market:
        # places are stored, so that both readings of them agree; a row a file has its first line
        lines = materialize(lines)
        first = lines.groupBy("file").agg(F.min(F.struct("begin", "at")).alias("first")).select("file", "first.begin", "first.at")
        lines = lines.join(first, ["file", "begin", "at"], "left_anti")
    part = F.split("line", r"\s+")
    return (
        lines.select(*[F.get(part, F.lit(i)).try_cast("bigint").alias(c) for i, c in enumerate(("src", "dst", "weight"))])
        .where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; a loop has no reverse of its own."""
    rest = [F.col(c) for c in edges.columns if c not in ("src", "dst")]
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select("src", "dst", *rest).unionAll(back)


def hashed_weights(edges: DataFrame, below: int = 10, out: str = "weight") -> DataFrame:
    """A weight 0 .. below - 1 for each edge, the same in every run: a multiplicative hash of the ends' low bits."""
    x = (F.col("src").bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(31) + F.col("dst").bitwiseAND(F.lit(0x7FFFFFFF))).bitwiseAND(F.lit(0x7FFFFFFF))
    return edges.withColumn(out, F.shiftright((x * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 16) % below)


@dataclass(frozen=True)
class NamedGraph:
    """Where a graph's file is, whether its edges run both ways, and where searches start."""

    file: str
    directed: bool = True
    start: int | None = None
    matrix_market: bool = False


class GraphRegistry:
    """Named graphs below a base folder for each mode."""

    def __init__(self, bases: Mapping[str, str], graphs: Mapping[str, NamedGraph]):
        self.bases, self.graphs = dict(bases), dict(graphs)

    def load(self, spark: SparkSession, name: str, mode: str) -> DataFrame:
        """The edges of a graph; unknown names and modes raise ValueError."""
        if name not in self.graphs:
            raise ValueError(f"unknown graph {name!r}; known: {', '.join(sorted(self.graphs))}")
        if mode not in self.bases:
            raise ValueError(f"unknown mode {mode!r}; known: {', '.join(sorted(self.bases))}")
        graph = self.graphs[name]
        edges = edge_list_text(spark, f"{self.bases[mode].rstrip('/')}/{graph.file}", graph.matrix_market)
        return edges if graph.directed else undirected(edges)


def edges_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """src, dst, mult, weight: parts of consecutive items of an order, with multiplicity and least quantity."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    step = lineitem.select(
        F.col("l_partkey").cast("bigint").alias("src"),
        F.lead(F.col("l_partkey").cast("bigint")).over(order).alias("dst"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    return step.where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("mult"), F.min("q").alias("weight"))
