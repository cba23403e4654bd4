"""Where relations and edges come from."""

from orrery.sources import edges, relations

__all__ = ["edges", "relations"]
