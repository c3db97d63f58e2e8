"""Row layouts that keep keyed work balanced when a few keys own most of the rows."""

from millrace.plans.spread import (
    chunked,
    global_slice,
    hot_keys,
    in_even_tasks,
    key_slice,
    latest_before,
    positions,
    previous,
    running_before,
    spread_join,
    whole_chunks,
)

__all__ = [
    "chunked",
    "global_slice",
    "hot_keys",
    "in_even_tasks",
    "key_slice",
    "positions",
    "previous",
    "running_before",
    "spread_join",
    "whole_chunks",
]
