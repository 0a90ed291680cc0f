"""All queries of the core and their SQL twins."""

from __future__ import annotations

from strataleaf.plans import core_problems, core_sql, q_extra, q_facts, q_graph, q_more, q_nodes, q_queue, q_routes, q_same_ids, q_sections, q_stats, q_stream, q_text, q_writes

_MODULES = (q_facts, q_nodes, q_same_ids, q_stats, q_text, q_graph, q_stream, q_more, q_extra, q_queue, q_routes, q_sections, q_writes)

QUERIES = {**core_problems.QUERIES}
SQL: dict[str, str] = {**core_sql.SQL}
for _m in _MODULES:
    if twice := QUERIES.keys() & _m.query.queries.keys():
        raise ValueError(f"queries stand twice: {twice}")
    QUERIES |= _m.query.queries
    SQL |= _m.query.sql
