"""Registered queries over the test tables."""

from millrace.queries import (
    aggregates,
    history,
    layouts,
    merge,
    paging,
    render,
    scalars,
    sources,
    streams,
    temporal,
    text,
)
from millrace.queries.registry import BUILDS, SQL

__all__ = [
    "BUILDS",
    "SQL",
    "aggregates",
    "history",
    "layouts",
    "merge",
    "paging",
    "render",
    "scalars",
    "sources",
    "streams",
    "temporal",
    "text",
]
