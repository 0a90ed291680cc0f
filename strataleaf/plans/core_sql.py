"""SQL twins of the core data problems, for DuckDB over the same tables."""

VERSIONS = """v as (select * from (select *, row_number() over (partition by version_id order by updated_at desc nulls last) rn
  from node_versions where version_id is not null) where rn = 1 and node_id is not null)"""

_P1 = f"""with {VERSIONS},
one as (select * from (select *, epoch_us(effective_from) eff, coalesce(validity_status = 'ARCHIVED', false) arch,
  row_number() over (partition by node_id, effective_from order by created_at desc nulls last, version_number desc nulls last, version_id desc) r2
  from v where effective_from is not null) where r2 = 1),
lagged as (select *, lag(arch) over w la, lag(content) over w lc, row_number() over w k from one window w as (partition by node_id order by eff)),
edges as (select * from lagged where arch or k = 1 or la or lc is distinct from content),
ended as (select *, lead(eff) over (partition by node_id order by eff) nx from edges)
select node_id, version_id, eff as from_us, coalesce(nx, -1) as to_us from ended where not arch"""

P2 = """with n as (select lower(trim(node_id, ' ')) k, min(ingestion_date) f from apex_ast_nodes where trim(node_id, ' ') <> '' group by 1),
g as (select distinct lower(trim(node_id, ' ')) k from node_versions where trim(node_id, ' ') <> ''),
r as (select 'apex_causal_edges' ref_table, 'source_node_id' ref_field, edge_id row_id, lower(trim(source_node_id, ' ')) k, discovered_at tm from apex_causal_edges
  union all select 'apex_causal_edges', 'target_node_id', edge_id, lower(trim(target_node_id, ' ')), discovered_at from apex_causal_edges
  union all select 'apex_temporal_metadata', 'superseded_by', node_id, lower(trim(superseded_by, ' ')), updated_at tm from apex_temporal_metadata)
select distinct ref_table, ref_field, row_id,
  case when n.k is not null then 'late' when g.k is not null then 'deleted' else 'missing' end as reason,
  coalesce(strftime(tm, '%Y-%m'), 'unknown') as period
from r left join n on n.k = r.k left join g on g.k = r.k
where r.k is not null and r.k <> '' and r.k not like 'entity:%' and (n.k is null or n.f > r.tm)"""

_P3 = f"""with {VERSIONS},
i as (select node_id, epoch_us(effective_from) s,
  case when effective_to is null or effective_to >= timestamp '9999-12-31' then 9223372036854775807 else epoch_us(effective_to) end e
  from v where effective_from is not null and coalesce(validity_status <> 'ARCHIVED', true)),
o as (select node_id, s, e, max(e) over (partition by node_id order by s, e rows between unbounded preceding and 1 preceding) m from i where e > s),
t as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by node_id order by s, e rows unbounded preceding) isl from o),
c as (select node_id, isl, min(s) f, max(e) t, bool_or(coalesce(s < m, false)) ov from t group by 1, 2),
l as (select *, lag(t) over (partition by node_id order by isl) b from c)
select node_id, 'merged' as kind, f as from_us, case when t = 9223372036854775807 then -1 else t end as to_us from c where ov
union all select node_id, 'gap', b, f from l where b is not null"""

_TREE = """n as (select * from (select *, lower(trim(node_id, ' ')) k, lower(trim(parent_id, ' ')) p, row_number() over
  (partition by lower(trim(node_id, ' ')) order by ingestion_date desc nulls last, node_id desc, parent_id desc nulls last, node_type desc nulls last, content desc nulls last) rn from apex_ast_nodes) where rn = 1),
l as (select n.k, n.node_id, m.k p from n left join n m on m.k = n.p),
t as (select k, node_id, node_id root, 0::bigint lv, [node_id] path, [k] ks from l where p is null
  union all select l.k, l.node_id, t.root, t.lv + 1, list_append(t.path, l.node_id), list_append(t.ks, l.k) from l join t on l.p = t.k),
c as (select u.a, count(*) - 1 n from (select unnest(ks) a from t) u group by 1)"""

TREE = f"with recursive {_TREE} @"

_P5 = f"""with recursive {_TREE}
select l.node_id, coalesce(t.root, 'cycle') as root_id, coalesce(t.lv, -1) as level_no, coalesce(c.n, -1) as n_desc
from l left join t on t.k = l.k left join c on c.a = l.k"""

SQL = {
    "p1_found": f"select version_id, from_us, to_us from ({_P1})",
    "p1_merged": f"select version_id, from_us, to_us from ({_P1})",
    "p1_current": f"select node_id, version_id, from_us from ({_P1}) where to_us = -1",
    "p2_found": P2,
    "p2_report": f"select ref_table, ref_field, reason, period, count(*) as n_refs from ({P2}) group by all",
    "p3_found": _P3,
    "p5_found": _P5,
    "p5_paths": f"with recursive {_TREE} select l.node_id, array_to_string(t.path, '/') as path from l left join t on t.k = l.k",
    "p5_descendants": f"""with recursive {_TREE} select a as ancestor_id, node_id, lv - i as distance from
(select node_id, lv, unnest(path) a, unnest(range(len(path))) i from t) where i < lv""",
}
