"""Vertex programs: a message along each edge, a merge at its head, an update of the vertex, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans import iterate, salted, sent


@dataclass(frozen=True)
class VertexProgram:
    """message(value, weight) -> Column; merge(Column) -> aggregate; update(old, merged) -> Column; changed(old, new) -> boolean.

    `update` sees a null `merged` where no message came. Only vertices whose value changed send.
    """

    message: Callable[[Column, Column], Column]
    merge: Callable[[Column], Column]
    update: Callable[[Column, Column], Column]
    changed: Callable[[Column, Column], Column] = lambda old, new: ~old.eqNullSafe(new)

    def run(self, edges: DataFrame, initial: DataFrame, rounds: int | None = None) -> DataFrame:
        """(id, value) once nothing changes, or after `rounds`; initial has id, value and active."""
        weighted = edges.select("src", "dst", "weight" if "weight" in edges.columns else F.lit(1).cast("bigint").alias("weight"))
        kept, hubs = salted(weighted)

        def step(state: DataFrame, _: int) -> DataFrame:
            senders = state.where("active").select(F.col("id").alias("src"), "value")
            came = kept.join(sent(senders, hubs), ["src", "salt"]).select(F.col("dst").alias("id"), self.message(F.col("value"), F.col("weight")).alias("came"))
            merged = came.groupBy("id").agg(self.merge(F.col("came")).alias("merged"))
            new = state.join(merged, "id", "left").select("id", "value", self.update(F.col("value"), F.col("merged")).alias("new"))
            return new.select("id", F.col("new").alias("value"), self.changed(F.col("value"), F.col("new")).alias("active"))

        def done(state: DataFrame, _: int) -> bool:
            return state.where("active").isEmpty()

        try:
            return iterate(initial.select("id", "value", "active"), step, done, rounds).select("id", "value")
        finally:
            kept.unpersist()


def shortest() -> VertexProgram:
    """Min-plus: distances over non-negative weights (BFS levels if every weight is 1)."""
    return VertexProgram(
        message=lambda value, weight: value + weight,
        merge=F.min,
        update=lambda old, merged: F.least(old, merged),
    )


def smallest_label() -> VertexProgram:
    """The smallest label that reaches a vertex; over undirected edges, its component's smallest id."""
    return VertexProgram(message=lambda value, _: value, merge=F.min, update=lambda old, merged: F.least(old, merged))
