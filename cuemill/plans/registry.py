"""All queries of the core, with the SQL each is checked against."""

from __future__ import annotations

from cuemill.plans import cue_queries, interval_queries, response_queries, run_queries, tqa_queries, wrap_queries

_MODULES = (interval_queries, cue_queries, response_queries, run_queries, tqa_queries, wrap_queries)
FLAGSHIP = "model_report"


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
