"""Writes run for real, into the shared folder or as the table that would replace the stored one."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataleaf.functions.ids import micros, norm_id
from strataleaf.operators import graph as G
from strataleaf.operators import sinks
from strataleaf.plans.base import Registry
from strataleaf.plans.q_facts import LEAD, facts
from strataleaf.session import materialise, new_path
from strataleaf.sources import schema
from strataleaf.sources.tables import table

query = Registry()
CUT = "2024-06-01"


def _cut():
    return F.lit(CUT).cast("timestamp_ntz")


_BIG = ("apex_ast_nodes", "node_versions", "apex_causal_edges", "apex_temporal_metadata")


@query("snk01_created_tables", f"select table_name, column_name, ordinal_position::int as position from information_schema.columns where table_name in {_BIG}")
def snk01(spark, d):
    """Tables made from the stated columns have those of the tables that are there."""
    folder = new_path(spark, "created")
    schema.create(spark, folder)
    return schema.columns_of(spark, folder, _BIG)


def _arrivals(spark, d):
    """Nodes by compared id, those that arrived before an instant as stored and the others as new."""
    n = table(spark, d, "apex_ast_nodes").withColumn("key", norm_id("node_id")).filter("key is not null")
    n = n.select("key", "doc_id", "content", "node_type", micros("ingestion_date").alias("us"))
    old = n.filter(F.col("us") < micros(_cut()))
    # the stored table has one row a node
    old = old.groupBy("key").agg(F.max(F.struct("us", "doc_id", "content", "node_type")).alias("v")).select("key", "v.doc_id", "v.content", "v.node_type", "v.us")
    return old, n.filter(~F.coalesce(F.col("us") < micros(_cut()), F.lit(False)))


@query("snk02_upserted_nodes", f"""with n as (select lower(trim(node_id, ' ')) as key, doc_id, content, node_type, epoch_us(ingestion_date) as us, ingestion_date < timestamp '{CUT}' as old from apex_ast_nodes where trim(node_id, ' ') <> ''),
o as (select * from (select *, row_number() over (partition by key order by us desc, doc_id desc, content desc, node_type desc) r from n where old) where r = 1),
w as (select * from (select *, row_number() over (partition by key order by us desc, doc_id desc, content desc, node_type desc) r from n where not coalesce(old, false)) where r = 1)
select coalesce(w.key, o.key) as key, coalesce(o.doc_id, w.doc_id) as doc_id, case when w.key is null then o.node_type else w.node_type end as node_type, md5(case when w.key is null then o.content else w.content end) as digest, coalesce(w.us, o.us) as us from o full join w on o.key = w.key""")
def snk02(spark, d):
    """A node that is there takes the new values but keeps its document."""
    old, new = _arrivals(spark, d)
    return sinks.upsert(old, new, "key", "us", ("doc_id",)).select("key", "doc_id", "node_type", F.md5("content").alias("digest"), "us")


@query("snk03_saved_edges", f"""with recursive e as (select * from (select *, row_number() over (partition by edge_id) r from apex_causal_edges) where r = 1), x as (select edge_id, source_node_id s, target_node_id t, coalesce(discovered_at < timestamp '{CUT}', false) old from e where edge_type in ('DEPENDS_ON', 'IMPORTS', 'REFERENCES')),
l as (select distinct s a, t b from x where old and s is not null and t is not null), q as (select distinct t from x where not old and s is not null and t is not null),
w as (select t source, t node from q union select w.source, l.b from w join l on l.a = w.node)
select edge_id, old or not exists (select 1 from w where w.source = x.t and w.node = x.s) as saved from x""")
def snk03(spark, d):
    """New edges into a stored graph: one whose target reaches its source, or is it, would close a cycle and is rejected."""
    e = table(spark, d, "apex_causal_edges").dropDuplicates(["edge_id"]).filter(F.col("edge_type").isin("DEPENDS_ON", "IMPORTS", "REFERENCES"))
    e = e.select("edge_id", F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"), F.coalesce(F.col("discovered_at") < _cut(), F.lit(False)).alias("old"))
    e = materialise(e, "edges")
    links = e.filter("old and s is not null and t is not null").select(F.col("s").alias("a"), F.col("t").alias("b"))
    new = e.filter("not old and s is not null and t is not null")
    closing = G.closing(links, new).select("edge_id").unionByName(new.filter("s = t").select("edge_id")).distinct().withColumn("closes", F.lit(True))
    return e.join(closing, "edge_id", "left").select("edge_id", F.col("closes").isNull().alias("saved"))


@query("snk04_page_index_entries", "select distinct lower(trim(node_id, ' ')) as node_id, lower(content) as term from apex_ast_nodes where node_type = 'HEADING' and trim(node_id, ' ') <> ''")
def snk04(spark, d):
    """Entries written one by one: one a node and term, however often it is delivered."""
    h = table(spark, d, "apex_ast_nodes").filter("node_type = 'HEADING'").select(norm_id("node_id").alias("node_id"), F.lower("content").alias("term")).filter("node_id is not null")
    stored = h.limit(0)
    return sinks.insert_new(stored, h, ["node_id", "term"])


_GONE = "gone as (select doc_id from apex_ast_nodes group by 1 having count(*) > 100), g as (select distinct node_id from apex_ast_nodes where doc_id in (from gone))"


@query("snk05_deleted_documents", f"""with {_GONE} select 'nodes' as kind, count(*) as n from apex_ast_nodes where doc_id is null or doc_id not in (from gone) union all
select 'edges', count(*) from (select * from apex_causal_edges) where source_node_id is null or source_node_id not in (from g where node_id is not null) union all select 'metadata', count(*) from apex_temporal_metadata where node_id is null or node_id not in (from g where node_id is not null)""")
def snk05(spark, d):
    """What stays when the documents of more than 100 rows are deleted: edges go by their source only."""
    n = table(spark, d, "apex_ast_nodes")
    docs = n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 100").select("doc_id")
    left = sinks.delete_documents(docs, n, table(spark, d, "apex_causal_edges"), table(spark, d, "apex_temporal_metadata"))
    count = lambda name, t: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("nodes", left[0]).unionByName(count("edges", left[1])).unionByName(count("metadata", left[2]))


@query("snk06_deleted_nodes", """with x as (select distinct lower(trim(node_id, ' ')) k from apex_temporal_metadata where validity_status = 'EXPIRED' and trim(node_id, ' ') <> ''), c as (select min(tenant_id) t from apex_ast_nodes)
select node_id, tenant_id, lower(trim(node_id, ' ')) in (from x) and tenant_id = (from c) as deleted from (select distinct node_id, tenant_id from apex_ast_nodes)""")
def snk06(spark, d):
    """Expired nodes, deleted by a caller who may delete only those of one tenant."""
    n = table(spark, d, "apex_ast_nodes").select("node_id", "tenant_id").distinct()
    gone = table(spark, d, "apex_temporal_metadata").filter("validity_status = 'EXPIRED'").select(norm_id("node_id").alias("k")).filter("k is not null").distinct()
    caller = table(spark, d, "apex_ast_nodes").agg(F.min("tenant_id").alias("caller"))
    j = n.withColumn("k", norm_id("node_id")).join(gone.withColumn("expired", F.lit(True)), "k", "left").crossJoin(F.broadcast(caller))  # one row
    return j.select("node_id", "tenant_id", (F.col("expired").isNotNull() & (F.col("tenant_id") == F.col("caller"))).alias("deleted"))


@query("snk07_appended_facts", f"{LEAD} select 'caller' as tenant_id, fact_id, subject from facts")
def snk07(spark, d):
    """Facts as they are stored: under the caller's tenant and not their own, read back from where they were appended."""
    path = new_path(spark, "facts")
    f = facts(spark, d).select("tenant_id", "fact_id", "subject", "created_at")
    for early in (True, False):
        sinks.append_for_tenant(f.filter((F.col("created_at") < F.lit("1995-01-01")) == early).drop("created_at"), "caller", path)
    return spark.read.parquet(path).select("tenant_id", "fact_id", "subject")


@query("snk10_saved_metadata", f"""with m as (select distinct lower(trim(node_id, ' ')) as key, freshness_score f, decay_rate r, epoch_us(effective_from) s, epoch_us(updated_at) u, coalesce(updated_at < timestamp '{CUT}', true) old from apex_temporal_metadata where trim(node_id, ' ') <> ''),
o as (select * from (select *, row_number() over (partition by key order by u desc nulls last, f desc nulls last, r desc, s desc) k from m where old) where k = 1), w as (select * from (select *, row_number() over (partition by key order by u desc nulls last, f desc nulls last, r desc, s desc) k from m where not old) where k = 1)
select coalesce(w.key, o.key) as key, case when w.key is null then o.f else w.f end as freshness_score, case when w.key is null then o.r else w.r end as decay_rate, coalesce(o.s, w.s) as from_us from o full join w on o.key = w.key""")
def snk10(spark, d):
    """Only freshness and decay of what is stored change; where a node has no metadata yet, all is new."""
    m = table(spark, d, "apex_temporal_metadata").select(
        norm_id("node_id").alias("key"), micros("updated_at").alias("u"), "freshness_score", "decay_rate", micros("effective_from").alias("from_us"),
        F.coalesce(F.col("updated_at") < _cut(), F.lit(True)).alias("old")).filter("key is not null")
    old = m.filter("old").groupBy("key").agg(F.max(F.struct("u", "freshness_score", "decay_rate", "from_us")).alias("v"))
    old = old.select("key", "v.u", "v.freshness_score", "v.decay_rate", "v.from_us")
    return sinks.upsert(old, m.filter("not old").drop("old"), "key", "u", ("from_us",)).select("key", "freshness_score", "decay_rate", "from_us")


@query("snk11_logged_events", "select event_type, ts::date as day, count(*) as n, max(event_id) as last_event from events group by 1, 2")
def snk11(spark, d):
    """Two appends to a log, read back."""
    e, path = table(spark, d, "events"), new_path(spark, "log")
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (e.filter(late), e.filter(~F.coalesce(late, F.lit(False)))):
        sinks.append_log(part, "ts", path)
    return spark.read.parquet(path).groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
