"""All registered queries."""

from __future__ import annotations

from loreline.plans import queries_items, queries_links, queries_marts, queries_series, queries_text  # noqa: F401
from loreline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
