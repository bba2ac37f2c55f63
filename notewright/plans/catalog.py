"""Registered queries over the music surrogates, with their DuckDB counterparts."""

from __future__ import annotations

from notewright.plans import event_queries, metric_queries, note_queries, token_queries
from notewright.plans.base import Query

MODULES = (note_queries, token_queries, event_queries, metric_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.R.sql.items()}
