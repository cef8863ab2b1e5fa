"""All registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from lorekeep.plans import context_queries, evaluated_queries, event_queries, graph_queries, maintenance_queries, markdown_queries, selection_queries, text_queries, vector_queries  # noqa: F401
from lorekeep.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
