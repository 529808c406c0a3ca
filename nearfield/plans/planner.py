"""Which way a search goes, by strategy, filter and mode."""

from __future__ import annotations

from enum import Enum

from ..types import Strategy


class SearchPlan(Enum):
    SCAN = "exact scan of the filtered rows"
    GRAPH = "graph walk"
    MASKED_GRAPH = "graph walk towards the rows that pass the filter"
    PROBE = "scan of the nearest lists"


def plan_search(strategy: Strategy, has_index: bool, has_filter: bool, mode: str = "none") -> SearchPlan:
    """A filter, or a caller's test, makes the exact scan the default: it is
    right at any selectivity. Only a graph in soft mode is walked under one."""
    if not has_index or strategy == Strategy.BRUTEFORCE:
        return SearchPlan.SCAN
    if has_filter:
        return SearchPlan.MASKED_GRAPH if strategy == Strategy.HNSW and mode == "soft" else SearchPlan.SCAN
    return SearchPlan.GRAPH if strategy == Strategy.HNSW else SearchPlan.PROBE
