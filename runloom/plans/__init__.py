"""The registry of queries and of the SQL that checks them."""

from __future__ import annotations


def registry() -> tuple[dict, dict]:
    """(queries, sql) of the core."""
    from runloom.plans import agent_queries, call_queries, data_queries, evaluation_queries, monitor_queries, reflection_queries, sample_queries, source_queries

    queries, sql = {}, {}
    for m in (data_queries, agent_queries, call_queries, evaluation_queries, monitor_queries, reflection_queries, sample_queries, source_queries):
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
