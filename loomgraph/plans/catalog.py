"""All queries of the library."""

from __future__ import annotations

from . import build_queries, graph_queries, learning_queries, model_queries, stats_queries, table_queries, text_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
