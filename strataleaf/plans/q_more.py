"""Further queries: generators of edges and facts, retrieval, caches, records, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.operators import extract as X
from strataleaf.operators import graph as G
from strataleaf.operators import search as R
from strataleaf.operators.slices import numbered
from strataleaf.plans import pipeline
from strataleaf.plans.base import Registry
from strataleaf.plans.q_facts import D90, _PAIR, facts
from strataleaf.plans.q_text import _tok, unicode_twin
from strataleaf.sources.markdown import parse_markdown
from strataleaf.sources.tables import SameIds, table

query = Registry()
_E = "e as (select distinct edge_id, source_node_id s, target_node_id t, edge_type k from apex_causal_edges)"


def _documents(spark, d):
    return table(spark, d, "documents")


for _name, _kind in (("gen02_metrics", "metric"), ("gen04_organizations", "organization"), ("gen06_products", "product"), ("gen07_events", "event"), ("gen08_contract_terms", "contract_term")):

    def _make(kind):
        return lambda spark, d: X.matches(_documents(spark, d), "doc_id", "text", kind)

    query(_name, unicode_twin(_kind) if _kind in ("metric", "event", "contract_term") else None)(_make(_kind))


@query("src02_markdown_nodes")
def src02(spark, d):
    return parse_markdown(_documents(spark, d).select("doc_id", "text"))


@query("gen12_fact_mentions", f"{D90} select tenant_id, doc_id, 'entity:' || lower(subject) as source, count(*) as n_facts from facts group by 1, 2, 3")
def gen12(spark, d):
    return facts(spark, d, 90).groupBy("tenant_id", "doc_id", F.concat(F.lit("entity:"), F.lower("subject")).alias("source")).agg(F.count(F.lit(1)).alias("n_facts"))


@query("gen15_policy_edges", r"""with p as (select doc_id, node_id, content from (select distinct doc_id, node_id, content from apex_ast_nodes) where regexp_matches(content, '\b(shall|must)\b'))
select 'policy:' || left(doc_id, 8) || '_' || row_number() over (partition by doc_id order by node_id, content) as source, node_id as target from p""")
def gen15(spark, d):
    n = table(spark, d, "apex_ast_nodes").select("doc_id", "node_id", "content").distinct().filter(F.rlike("content", F.lit(r"\b(shall|must)\b")))
    n = numbered(n, "doc_id", "node_id")
    return n.select(F.concat(F.lit("policy:"), F.substring("doc_id", 1, 8), F.lit("_"), F.col("position").cast("string")).alias("source"), F.col("node_id").alias("target"))


@query("gen17_fact_pairs", f"{D90} select a.fact_id as source, b.fact_id as target, case when a.object <> b.object then 'CONTRADICTS' else 'SUPPORTS' end as edge_type {_PAIR} where a.fact_id < b.fact_id")
def gen17(spark, d):
    """Facts of one subject of a document: a customer's orders of one priority, a handful each."""
    f = facts(spark, d, 90)
    side = lambda x: f.select("tenant_id", "doc_id", "subject", F.col("fact_id").alias(x), F.col("object").alias(f"o_{x}"))
    j = side("source").join(side("target"), ["tenant_id", "doc_id", "subject"]).filter("source < target")
    return j.select("source", "target", F.when(F.col("o_source") != F.col("o_target"), "CONTRADICTS").otherwise("SUPPORTS").alias("edge_type"))


@query("gen14_resolved_tables", r"""with r as (select doc_id, node_id, unnest(regexp_extract_all(content, 'See table (\d+)', 1)) no from (select distinct doc_id, node_id, content from apex_ast_nodes)),
f as (select doc_id, regexp_extract(content, '^Figure (\d+)', 1) no, min(node_id) target from apex_ast_nodes where node_type = 'IMAGE' group by 1, 2)
select distinct r.node_id as source, f.target from r join f on f.doc_id = r.doc_id and f.no = r.no and r.no <> ''""")
def gen14(spark, d):
    """References by number within a document, joined to what bears the number."""
    n = table(spark, d, "apex_ast_nodes")
    refs = n.select("doc_id", "node_id", "content").distinct().select("doc_id", F.col("node_id").alias("source"), F.explode(F.regexp_extract_all("content", F.lit(r"See table (\d+)"), F.lit(1))).alias("no"))
    at = n.filter("node_type = 'IMAGE'").groupBy("doc_id", F.regexp_extract("content", r"^Figure (\d+)", 1).alias("no")).agg(F.min("node_id").alias("target"))
    return refs.filter("no <> ''").join(at, ["doc_id", "no"]).select("source", "target").distinct()


@query("gen19_signposts", "select node_id, left(content, 120) as signpost from (select distinct node_id, content from apex_ast_nodes where node_type in ('HEADING', 'LIST')) where node_id in (select parent_id from apex_ast_nodes)")
def gen19(spark, d):
    """What stands for a section's summary where no completer is given: its first characters."""
    n = table(spark, d, "apex_ast_nodes")
    inner = n.select(F.col("parent_id").alias("node_id")).filter("node_id is not null").distinct()
    n = n.filter(F.col("node_type").isin("HEADING", "LIST")).select("node_id", "content").distinct()
    return n.join(inner, "node_id", "left_semi").select("node_id", F.substring("content", 1, 120).alias("signpost"))


_NAV = f"""with q as (select item_id, unnest(list_distinct({_tok('question')})) term from eval_items), d as (select doc_id, {_tok('text')} own from documents), x as (select doc_id, len(own) n, unnest(own) term from d),
p as (select term, doc_id, any_value(n) n, count(*) tf from x group by 1, 2), h as (select item_id, doc_id, round(sum(tf / n), 9) score from q join p using (term) group by 1, 2),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) position from h)"""


@query("qry03_navigate", f"{_NAV} select item_id, doc_id, position from r where position <= 5")
def qry03(spark, d):
    return pipeline.navigate(table(spark, d, "eval_items"), _documents(spark, d)).select("item_id", "doc_id", "position")


@query("qry01_answers", f"{_NAV} select item_id, count(*) as n_evidence, left(min_by(text, position), 120) as answer from r join documents using (doc_id) where position <= 5 group by 1")
def qry01(spark, d):
    return pipeline.answers(table(spark, d, "eval_items"), _documents(spark, d)).drop("confidence")


@query("qry10_best_document", f"{_NAV} select item_id, doc_id from r where position = 1")
def qry10(spark, d):
    return pipeline.navigate(table(spark, d, "eval_items"), _documents(spark, d), 1).select("item_id", "doc_id")


@query("joi04_search_then_nodes", """with h as (select doc_id, count(*) c from apex_ast_nodes where node_type = 'HEADING' and content ilike '%retention%' group by 1 order by c desc, doc_id limit 50)
select doc_id, node_id from apex_ast_nodes where doc_id in (select doc_id from h) and node_type = 'HEADING'""")
def joi04(spark, d):
    """The top 50 documents by hits, and their headings; the limit is the report's."""
    h = table(spark, d, "apex_ast_nodes").filter("node_type = 'HEADING'").select("doc_id", "node_id", "content")
    top = h.filter(F.col("content").ilike("%retention%")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "doc_id").limit(50)
    return h.join(top, "doc_id", "left_semi").select("doc_id", "node_id")


@query("srt11_search_children", """select parent_id, node_id, score from (select parent_id, node_id, max(2.0 * contains(lower(content), 'retention')::int + 1.0 * contains(lower(content), 'schedule')::int)::double score from apex_ast_nodes where parent_id is not null group by 1, 2) where score > 0""")
def srt11(spark, d):
    low = F.lower("content")
    score = F.max(2.0 * F.contains(low, F.lit("retention")).cast("int") + 1.0 * F.contains(low, F.lit("schedule")).cast("int"))
    n = table(spark, d, "apex_ast_nodes").filter("parent_id is not null").groupBy("parent_id", "node_id").agg(score.alias("score"))
    return n.filter("score > 0")


@query("str11_unbuilt_projections", f"with {_E}, n as (select distinct doc_id, node_id from apex_ast_nodes), b as (select distinct n.doc_id from e join n on n.node_id = e.s where e.k = 'REFERENCES') select distinct doc_id from n where doc_id not in (from b)")
def str11(spark, d):
    """Documents whose citation projection has not been built."""
    n = table(spark, d, "apex_ast_nodes").select("doc_id", F.col("node_id").alias("s")).distinct()
    e = table(spark, d, "apex_causal_edges").filter("edge_type = 'REFERENCES'").select(F.col("source_node_id").alias("s")).distinct()
    built = n.join(e, "s", "left_semi").select("doc_id").distinct()
    return n.select("doc_id").distinct().join(built, "doc_id", "left_anti")


@query("fn30_json_records", "select event_id, try_cast(props::json ->> '$.k' as bigint) as k, props is not null as is_record from events")
def fn30(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.col("props").isNotNull().alias("is_record"))


@query("fn16_source_dates")
def fn16_all(spark, d):
    """The date of the best kind of eight in a text's first 500 characters."""
    return _documents(spark, d).select("doc_id", X.first_date(F.col("text")).alias("source_date"))


@query("set05_map_diff", """with v as (select distinct user_id, event_type, (ts >= timestamp '2024-01-15') late from events), x as (select user_id, event_type, bool_or(not late) a, bool_or(late) b from v group by 1, 2)
select user_id, count_if(b and not a) as n_added, count_if(a and not b) as n_removed, count_if(a and b) as n_kept from x group by 1""")
def set05(spark, d):
    """Keys that an entity has before and after an instant, compared."""
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    x = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.bool_or(~late).alias("a"), F.bool_or(late).alias("b"))
    return x.groupBy("user_id").agg(F.count_if(F.expr("b and not a")).alias("n_added"), F.count_if(F.expr("a and not b")).alias("n_removed"), F.count_if(F.expr("a and b")).alias("n_kept"))


def _same_edges(spark, d):
    return table(spark, SameIds(d), "apex_causal_edges").select("edge_id", F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"), "edge_type").distinct()


_SAME = "e as (select distinct edge_id, case when starts_with(lower(trim(source_node_id, ' ')), 'entity:') then source_node_id else nullif(lower(trim(source_node_id, ' ')), '') end s, case when starts_with(lower(trim(target_node_id, ' ')), 'entity:') then target_node_id else nullif(lower(trim(target_node_id, ' ')), '') end t, edge_type k from apex_causal_edges)"
_REACH = "w as (select a, b from l union select w.a, l.b from w join l on l.a = w.b)"


@query("grf07_closes_cycle", f"with recursive {_SAME}, l as (select distinct s a, t b from e where k in ('DEPENDS_ON', 'IMPORTS', 'REFERENCES') and s is not null and t is not null), {_REACH} select distinct e.edge_id from e join w on w.a = e.t and w.b = e.s")
def grf07_all(spark, d):
    """Edges whose target reaches their source over dependency links, however many: adding them closes a cycle."""
    e = _same_edges(spark, d)
    l = e.filter(F.col("edge_type").isin("DEPENDS_ON", "IMPORTS", "REFERENCES")).select(F.col("s").alias("a"), F.col("t").alias("b"))
    return G.closing(l, e).select("edge_id").distinct()


@query("grf08_nodes_on_cycles", f"with recursive {_SAME}, l as (select distinct s a, t b from e where s is not null and t is not null), {_REACH} select distinct a as node_id from w where a = b")
def grf08_all(spark, d):
    """Nodes from which edges lead back to them."""
    return G.on_cycles(_same_edges(spark, d).select(F.col("s").alias("a"), F.col("t").alias("b")).filter("a is not null and b is not null")).select(F.col("node").alias("node_id"))


@query("joi18_permitted_documents", """with g as (select distinct source, n % 3 <> 0 ok from (select source, dense_rank() over (order by source) n from (select distinct source from documents where source is not null)))
select doc_id from documents join g using (source) where ok""")
def joi18(spark, d):
    """Rows joined with a permission table; what it denies or doesn't name is dropped."""
    docs = _documents(spark, d).select("doc_id", "source")
    grants = docs.filter("source is not null").select("source").distinct().withColumn("n", F.dense_rank().over(Window.orderBy("source")))
    return docs.join(grants.filter("n % 3 <> 0"), "source", "left_semi").select("doc_id")
