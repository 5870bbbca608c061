"""All registered queries and their SQL checks."""

from __future__ import annotations

from assayer.plans import answer_queries, io_queries, metric_queries, plan_queries, record_queries

MODULES = (metric_queries, answer_queries, record_queries, plan_queries, io_queries)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
