"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from strataq.plans import ingest_queries, planning_queries, retrieval_queries, search_queries

_ALL = (retrieval_queries, planning_queries, ingest_queries, search_queries)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _ALL for name, sql in module.ORACLES.items()}
