"""Queries over the edges, the supersession links and the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataleaf.functions.ids import norm_id
from strataleaf.operators import graph as G
from strataleaf.operators import likeness as L
from strataleaf.operators import search as R
from strataleaf.operators.hierarchy import hierarchy
from strataleaf.operators.policy import Rule, condition
from strataleaf.plans.base import Registry
from strataleaf.sources.tables import table

query = Registry()
_BLANKS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Each embedded node as the row that counts has it, and each two of a document.
EMBEDDED = rf"""n as (select * from (select *, lower(trim(node_id, ' ')) k, row_number() over (partition by lower(trim(node_id, ' ')) order by ingestion_date desc nulls last, doc_id desc nulls last, parent_id desc nulls last, embedding desc nulls last, content desc nulls last, source_date desc nulls last) r from apex_ast_nodes where trim(node_id, ' ') <> '') where r = 1),
m as (select k id, doc_id doc, nullif(lower(trim(parent_id, ' ')), '') parent, embedding v, content, source_date, regexp_replace(lower(coalesce(content, '')), '^{_BLANKS}|{_BLANKS}$', '', 'g') same from n where len(embedding) = 4 and list_sum([x * x for x in embedding]) > 0),
pr as (select a.id x, b.id y, a.parent xp, b.parent yp, a.content xc, b.content yc, a.same xs, b.same ys, a.source_date xd, b.source_date yd, list_cosine_similarity(a.v, b.v) cos from m a join m b on a.doc = b.doc and a.id < b.id)"""


def likeness_sql(hit: str, counted: str = "true") -> str:
    """Twin of like_nodes: classes over the pairs that ``hit``, and how many links, of those that are ``counted``, a node has."""
    return f"""with recursive {EMBEDDED}, h as (select x, y, {counted} counts from pr where {hit}), u as (select x, y, counts from h union all select y, x, counts from h),
c as (select id a, id b from m union select c.a, u.y from c join u on u.x = c.b), d as (select a, min(b) class_id from c group by 1)
select m.id as node_id, d.class_id, (select count(*) from u where u.x = m.id and u.counts) as n_links from m join d on d.a = m.id"""
_E = "e as (select distinct edge_id, source_node_id s, target_node_id t, edge_type k, strength from apex_causal_edges)"


def edges(spark, d):
    return table(spark, d, "apex_causal_edges").select("edge_id", F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"), F.col("edge_type").alias("k"), "strength").distinct()


def _roots(spark, d):
    return table(spark, d, "apex_ast_nodes").filter("parent_id is null").select(F.col("node_id").alias("node")).distinct()


_UND = f"{_E}, u as (select s a, t b from e where k not in ('CONTRADICTS', 'OVERRIDES') and s is not null and t is not null union select t, s from e where k not in ('CONTRADICTS', 'OVERRIDES') and s is not null and t is not null)"
_BFS = f"with recursive {_UND}, w as (select distinct node_id node, 0::bigint h from apex_ast_nodes where parent_id is null union select u.b, w.h + 1 from w join u on u.a = w.node where w.h < {{0}}) select node, min(h) as hops from w group by 1"


@query("grf01_bfs_from_roots", _BFS.format(3))
def grf01(spark, d):
    """Fewest hops from any root node, up to 3, over all edges but those that contradict or override."""
    e = edges(spark, d).filter(~F.col("k").isin("CONTRADICTS", "OVERRIDES"))
    return G.hops(G.undirected(e, "s", "t"), _roots(spark, d), 3)


@query("grf03_ego_edges", f"with {_E}, r as (select distinct node_id n from apex_ast_nodes where parent_id is null) select distinct edge_id from e where s in (from r) or t in (from r)")
def grf03(spark, d):
    e, r = edges(spark, d), _roots(spark, d)
    out = e.join(r, e["s"] == r["node"], "left_semi").unionByName(e.join(r, e["t"] == r["node"], "left_semi"))
    return out.select("edge_id").distinct()


@query("grf04_reasoning_chain", f"with recursive {_UND}, w as (select distinct node_id node, 0::bigint h from apex_ast_nodes where parent_id is null union select u.b, w.h + 1 from w join u on u.a = w.node where w.h < 2), v as (select distinct node from w) select k as edge_type, count(*) as n_edges, round(avg(strength), 6) as mean_strength from e where s in (from v) and t in (from v) group by 1")
def grf04(spark, d):
    """Edges among the nodes within two hops of the roots, by type, with their mean strength."""
    e = edges(spark, d)
    near = G.hops(G.undirected(e.filter(~F.col("k").isin("CONTRADICTS", "OVERRIDES")), "s", "t"), _roots(spark, d), 2).select("node")
    e = e.join(near, e["s"] == near["node"], "left_semi")
    e = e.join(near, e["t"] == near["node"], "left_semi")
    return e.groupBy(F.col("k").alias("edge_type")).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("strength"), 6).alias("mean_strength"))


@query("grf05_dependencies", f"""with recursive {_E}, l as (select distinct s a, t b from e where k in ('DEPENDS_ON', 'IMPORTS', 'REFERENCES') and s is not null and t is not null),
w as (select a source, b node, 1::bigint h from l union select w.source, l.b, w.h + 1 from w join l on l.a = w.node where w.h < 4) select source, node, min(h) as hops from w group by 1, 2""")
def grf05(spark, d):
    e = edges(spark, d).filter(F.col("k").isin("DEPENDS_ON", "IMPORTS", "REFERENCES"))
    return G.closure(e.select(F.col("s").alias("a"), F.col("t").alias("b")), 4)


@query("grf06_cyclic_edges", f"""with recursive {_E}, l as (select distinct s a, t b from e where s is not null and t is not null), w as (select a, b from l union select w.a, l.b from w join l on l.a = w.b), c as (select distinct a n from w where a = b),
f as (select n from c union select w.b from w join c on c.n = w.a), g as (select n from c union select w.a from w join c on c.n = w.b) select a, b from l where a in (from f) and b in (from g)""")
def grf06(spark, d):
    """Links that lie on cycles or between them: a write-time check would have to reject some of these."""
    return G.cyclic_core(edges(spark, d).select(F.col("s").alias("a"), F.col("t").alias("b")))


_SUP = """m as (select lower(trim(node_id, ' ')) k, max(nullif(lower(trim(superseded_by, ' ')), '')) p from apex_temporal_metadata where trim(node_id, ' ') <> '' group by 1), l as (select m.k, x.k p from m left join m x on x.k = m.p),
t as (select k, k root, 0::bigint lv from l where p is null union all select l.k, t.root, t.lv + 1 from l join t on l.p = t.k)"""


@query("grf16_latest_by_supersession", f"with recursive {_SUP} select l.k as node_id, coalesce(t.root, 'cycle') as latest_id, coalesce(t.lv, -1) as steps from l left join t on t.k = l.k")
def grf16(spark, d):
    """The end of each node's chain of superseding nodes; chains that go round have none."""
    m = table(spark, d, "apex_temporal_metadata").select(norm_id("node_id").alias("key"), norm_id("superseded_by").alias("p")).filter("key is not null")
    m = m.groupBy("key").agg(F.max("p").alias("parent")).select("key", F.col("key").alias("name"), "parent")
    return hierarchy(m).select("node_id", F.col("root_id").alias("latest_id"), F.col("level_no").alias("steps"))


@query("grf17_amendment_chains", f"with recursive {_SUP} select root as latest_id, max(lv) as longest, count(*) as n_nodes from t group by 1 having count(*) > 1")
def grf17(spark, d):
    h = grf16(spark, d).filter("steps >= 0").groupBy("latest_id")
    return h.agg(F.max("steps").alias("longest"), F.count(F.lit(1)).alias("n_nodes")).filter("n_nodes > 1")


@query("grf23_digraph", f"with {_E} select s as source, t as target, count(*) as n_edges, max(strength) as strength from e where s is not null and t is not null group by 1, 2")
def grf23(spark, d):
    e = edges(spark, d).filter("s is not null and t is not null")
    return e.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count(F.lit(1)).alias("n_edges"), F.max("strength").alias("strength"))


@query("agg16_entity_mentions", f"with {_E} select t as entity, count(*) as n_edges, count(distinct s) as n_nodes from e where t like 'entity:%' group by 1")
def agg16(spark, d):
    return edges(spark, d).filter(F.col("t").startswith("entity:")).groupBy(F.col("t").alias("entity")).agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("s").alias("n_nodes"))


@query("agg16_co_mentions", f"with {_E}, m as (select distinct s, t from e where t like 'entity:%' and s is not null) select a.t as entity_a, b.t as entity_b, count(*) as n_nodes, round(least(0.5 + 0.1 * count(*), 1.0)::double, 6) as strength from m a join m b on a.s = b.s and a.t < b.t group by 1, 2")
def agg16b(spark, d):
    """Entities that one node mentions: pairs within a node, which has a few."""
    m = edges(spark, d).filter(F.col("t").startswith("entity:") & F.col("s").isNotNull()).select("s", F.col("t").alias("entity_a")).distinct()
    j = m.join(m.withColumnRenamed("entity_a", "entity_b"), "s").filter("entity_a < entity_b").groupBy("entity_a", "entity_b")
    j = j.agg(F.count(F.lit(1)).alias("n_nodes"))
    return j.withColumn("strength", F.round(F.least(0.5 + 0.1 * F.col("n_nodes"), F.lit(1.0)), 6))


@query("joi14_semantic_links", likeness_sql("cos >= 0.75 and not (coalesce(xp = y, false) or coalesce(yp = x, false) or coalesce(xp = yp, false))"))
def joi14_all(spark, d):
    """Nodes of a document at cosine 0.75 or more that are neither parent and child nor siblings: each embedded node's class
    over these links and how many it has."""
    return L.like_nodes(L.embedded(table(spark, d, "apex_ast_nodes")), 0.75, closed=True, apart=True)


@query("flt20_rule", "select doc_id from documents where coalesce(lang in ('en', 'de'), false) and coalesce(starts_with(source, 'wiki'), false) and coalesce(n_chars >= 500, false)")
def flt20(spark, d):
    rules = [Rule("lang", "IN", ["en", "de"]), Rule("source", "STARTS_WITH", "wiki"), Rule("n_chars", "GTE", 500)]
    return table(spark, d, "documents").filter(condition(rules)).select("doc_id")


@query("flt21_any_rule", "select doc_id from documents where coalesce(lang not in ('en', 'de'), false) or coalesce(ends_with(source, 'legal'), false) or coalesce(n_chars < 100, false) or coalesce(contains(source, 'intake'), false)")
def flt21(spark, d):
    rules = [Rule("lang", "NOT_IN", ["en", "de"]), Rule("source", "ENDS_WITH", "legal"), Rule("n_chars", "LT", 100), Rule("source", "CONTAINS", "intake")]
    return table(spark, d, "documents").filter(condition(rules, "ANY")).select("doc_id")
