"""Registered queries over the dataset tables."""

from paperloom.plans import (  # noqa: F401
    compare,
    edits,
    grid,
    pii,
    profile,
    search,
    sessions,
    sources,
    streams,
    structure,
    surface,
    versions,
)
from paperloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
