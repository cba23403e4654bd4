"""Column expressions."""

from orrery.functions import scalar

__all__ = ["scalar"]
