"""Joins, graph preparation, vertex programs and iterative algorithms."""

from orrery.operators import algorithms, components, graph, joins, program

__all__ = ["algorithms", "components", "graph", "joins", "program"]
