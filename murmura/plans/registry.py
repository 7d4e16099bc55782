"""Named queries and the SQL that checks them."""

from __future__ import annotations

from murmura.plans import experiment_queries, index_queries, retrieval_queries, security_queries, text_queries, vector_queries

_MODULES = (text_queries, vector_queries, retrieval_queries, security_queries, experiment_queries, index_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
