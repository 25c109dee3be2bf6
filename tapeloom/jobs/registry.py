"""All registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from tapeloom.jobs import analysis_queries, panel_queries, research_run, stream_queries, trading_queries, workload_queries

_MODULES = [panel_queries, trading_queries, analysis_queries, research_run, stream_queries, workload_queries]
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
