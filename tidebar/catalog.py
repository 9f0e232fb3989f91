"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from .plans import bar_queries, chart_queries, market_queries, merge_queries, source_queries, stream_queries

MODULES = (bar_queries, market_queries, chart_queries, merge_queries, source_queries, stream_queries)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
