"""All queries of the training-data operators, with SQL where there is any."""

from __future__ import annotations

from cuemill.llm import consensus_queries, garbled_queries, mixing_queries, packing_queries, pairs_queries, quality_queries, split_queries

_MODULES = (consensus_queries, garbled_queries, mixing_queries, split_queries, packing_queries, pairs_queries, quality_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
