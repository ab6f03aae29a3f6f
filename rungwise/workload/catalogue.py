"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from rungwise.workload import (
    asof_queries,
    function_queries,
    label_queries,
    quality_queries,
    scoring_queries,
    select_queries,
)

MODULES = (
    scoring_queries,
    asof_queries,
    select_queries,
    label_queries,
    function_queries,
    quality_queries,
)


def all_queries() -> dict:
    merged: dict = {}
    for module in MODULES:
        merged.update(module.QUERIES)
    return merged
