"""Queries by name, and SQL by the same names."""

from __future__ import annotations

from srcgraph.plans import chain_queries, fact_queries, source_queries, update_queries

_MODULES = (fact_queries, source_queries, update_queries, chain_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
