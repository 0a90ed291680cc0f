"""Queries that join node ids, over ids without blanks at their ends and lower-cased: an oddly written reference counts.

Each is the query of the same name without ``_same_ids`` over tables whose ids are read so, with a twin of the same kind."""

from __future__ import annotations

import re

from strataleaf.plans import q_extra, q_graph, q_nodes
from strataleaf.plans.base import Query, Registry
from strataleaf.sources.tables import NODE_IDS, SameIds

query = Registry()
_RAW = (
    "joi01_edges_of_nodes", "joi02_edges_by_projection", "joi03_all_edges", "joi05_graph_as_of", "gen13_structural_edges", "src14_leaf_flags", "agg02_document_stats",
    "flt01_nodes_by_ids", "grf01_bfs_from_roots", "grf02_hops_to_entities", "grf03_ego_edges", "grf04_reasoning_chain", "grf05_dependencies",
)


def _same_sql(sql: str) -> str:
    same = lambda c: f"case when starts_with(lower(trim({c}, ' ')), 'entity:') then {c} else nullif(lower(trim({c}, ' ')), '') end as {c}"
    read = lambda m: f"(select * replace ({', '.join(map(same, NODE_IDS[m[0]]))}) from {m[0]})"
    return re.sub(rf"\b(?:{'|'.join(NODE_IDS)})\b", read, sql)


def _over_same_ids(raw: Query) -> Query:
    return lambda spark, d: raw(spark, SameIds(d))


for _m in (q_nodes, q_graph, q_extra):
    for _n in _RAW:
        if _n in _m.query.queries:
            query(f"{_n}_same_ids", _same_sql(_m.query.sql[_n]))(_over_same_ids(_m.query.queries[_n]))
