"""All queries of this package and their SQL, by name."""

from __future__ import annotations

from strataq.llm import base_queries, corpus_queries, dedup_queries, packing_query

QUERIES = {**dedup_queries.QUERIES, **base_queries.QUERIES, **packing_query.QUERIES, **corpus_queries.QUERIES}
ORACLES = {**base_queries.ORACLES, **dedup_queries.ORACLES, **corpus_queries.ORACLES}
