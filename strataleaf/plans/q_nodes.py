"""Queries over nodes, versions, metadata and edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.operators import facts as O
from strataleaf.operators import temporal as T
from strataleaf.plans.base import Registry
from strataleaf.operators.slices import numbered, running
from strataleaf.session import materialise
from strataleaf.sources.tables import table

query = Registry()
T0, T1, NOW = "2024-06-01", "2025-01-01", "2025-06-01"


def nodes(spark, d):
    return table(spark, d, "apex_ast_nodes")


def versions(spark, d):
    return table(spark, d, "node_versions")


def edges(spark, d):
    """Distinct edges; redelivered rows are identical but for array columns, which can't be compared by SQL alike."""
    return table(spark, d, "apex_causal_edges").dropDuplicates(["edge_id"])


EDGES = "e as (select * from (select *, row_number() over (partition by edge_id) r from apex_causal_edges) where r = 1)"
_IN = "effective_from <= timestamp '{0}' and (effective_to is null or effective_to > timestamp '{0}')"
_PATH = "coalesce(node_id, '') node_id"


@query("flt01_nodes_by_ids", "select node_id, doc_id, node_type from apex_ast_nodes where node_id in (select superseded_by from apex_temporal_metadata)")
def flt01(spark, d):
    ids = table(spark, d, "apex_temporal_metadata").select(F.col("superseded_by").alias("node_id"))
    return nodes(spark, d).join(ids, "node_id", "left_semi").select("node_id", "doc_id", "node_type")


@query("flt02_nodes_of_tenant", "select node_id, doc_id from apex_ast_nodes where tenant_id = 'tenant-b'")
def flt02(spark, d):
    return nodes(spark, d).filter("tenant_id = 'tenant-b'").select("node_id", "doc_id")


@query("flt03_root_nodes", "select node_id, doc_id from apex_ast_nodes where parent_id is null")
def flt03(spark, d):
    return nodes(spark, d).filter("parent_id is null").select("node_id", "doc_id")


@query("flt13_versions_as_of", f"select version_id, node_id from node_versions where {_IN.format(T1)}")
def flt13(spark, d):
    return versions(spark, d).filter(O.valid_at(T1, "effective_from", "effective_to")).select("version_id", "node_id")


@query("flt14_versions_in_range", f"select version_id, node_id from node_versions where effective_from <= timestamp '{T1}' and (effective_to is null or effective_to >= timestamp '{T0}')")
def flt14(spark, d):
    return versions(spark, d).filter(O.in_range_closed(T0, T1)).select("version_id", "node_id")


@query("flt15_versions_before_after", f"""select version_id, 'before' as side from node_versions where effective_from < timestamp '{T0}'
union all select version_id, 'after' from node_versions where effective_from > timestamp '{T1}'""")
def flt15(spark, d):
    side = F.when(F.col("effective_from") < O.instant(T0), "before").when(F.col("effective_from") > O.instant(T1), "after")
    return versions(spark, d).select("version_id", side.alias("side")).filter("side is not null")


@query("flt16_unexpired_nodes", f"""select node_id, doc_id from apex_ast_nodes n left join (select node_id k, bool_or(coalesce(validity_status in ('ACTIVE', 'PENDING') and {_IN.format(NOW)}, false)) ok
from apex_temporal_metadata group by 1) m on m.k = n.node_id where coalesce(ok, true)""")
def flt16(spark, d):
    return T.unexpired(nodes(spark, d), table(spark, d, "apex_temporal_metadata"), NOW).select("node_id", "doc_id")


@query("flt17_obsolete_nodes_removed", """with s as (select distinct node_id from apex_temporal_metadata where superseded_by is not null and trim(superseded_by) <> '' or validity_status in ('SUPERSEDED', 'EXPIRED'))
select node_id, doc_id from apex_ast_nodes where node_id not in (select node_id from s where node_id is not null)""")
def flt17(spark, d):
    m = table(spark, d, "apex_temporal_metadata")
    gone = m.filter((F.trim("superseded_by") != "") | F.col("validity_status").isin("SUPERSEDED", "EXPIRED")).select("node_id")
    return nodes(spark, d).join(gone, "node_id", "left_anti").select("node_id", "doc_id")


_JOIN = f"with {EDGES}, n as (select distinct node_id, doc_id, tenant_id from apex_ast_nodes)"


def _joined(spark, d):
    """Edges with the document of their source node; an edge whose source is no node isn't read back."""
    n = nodes(spark, d).select(F.col("node_id").alias("source_node_id"), "doc_id", "tenant_id").distinct()
    return edges(spark, d).join(n, "source_node_id")


@query("joi01_edges_of_nodes", f"""{_JOIN}, x as (select e.edge_id, e.source_node_id, e.target_node_id from e join n on n.node_id = e.source_node_id)
select source_node_id as node_id, edge_id from x union select target_node_id, edge_id from x where target_node_id is not null""")
def joi01(spark, d):
    e = _joined(spark, d).select("edge_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    return e.filter("node_id is not null").select("node_id", "edge_id").distinct()


@query("joi02_edges_by_projection", f"{_JOIN} select e.edge_id, n.doc_id, e.edge_type from e join n on n.node_id = e.source_node_id where list_contains(projections, 'citation')")
def joi02(spark, d):
    return _joined(spark, d).filter(F.array_contains("projections", "citation")).select("edge_id", "doc_id", "edge_type")


@query("joi03_all_edges", f"{_JOIN} select e.edge_id, n.doc_id, n.tenant_id from e join n on n.node_id = e.source_node_id")
def joi03(spark, d):
    return _joined(spark, d).select("edge_id", "doc_id", "tenant_id")


@query("joi05_graph_as_of", f"""with {EDGES}, v as (select distinct node_id from node_versions where {_IN.format(T1)})
select edge_id, source_node_id, target_node_id from e where discovered_at <= timestamp '{T1}' and source_node_id in (from v) and target_node_id in (from v)""")
def joi05(spark, d):
    v = versions(spark, d).filter(O.valid_at(T1, "effective_from", "effective_to")).select("node_id").distinct()
    e = edges(spark, d).filter(F.col("discovered_at") <= O.instant(T1)).select("edge_id", "source_node_id", "target_node_id")
    e = e.join(v.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
    return e.join(v.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi").select("edge_id", "source_node_id", "target_node_id")


@query("joi17_graph_labels", f"""with {EDGES}, p as (select source_node_id id from e union select target_node_id from e), n as (select node_id, max(left(content, 80)) label from apex_ast_nodes group by 1)
select id, coalesce(label, left(id, 8)) as label from p left join n on n.node_id = p.id where id is not null""")
def joi17(spark, d):
    ids = edges(spark, d).select(F.explode(F.array("source_node_id", "target_node_id")).alias("id")).filter("id is not null").distinct()
    labels = nodes(spark, d).groupBy(F.col("node_id").alias("id")).agg(F.max(F.substring("content", 1, 80)).alias("label"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("label", F.substring("id", 1, 8)).alias("label"))


@query("joi19_foreign_tenant_ends", f"""with {EDGES}, n as (select node_id, max(tenant_id) t from apex_ast_nodes group by 1)
select e.edge_id, a.t as source_tenant, b.t as target_tenant from e join n a on a.node_id = e.source_node_id join n b on b.node_id = e.target_node_id where a.t <> b.t""")
def joi19(spark, d):
    n = nodes(spark, d).groupBy("node_id").agg(F.max("tenant_id").alias("t"))
    e = edges(spark, d).select("edge_id", "source_node_id", "target_node_id")
    e = e.join(n.select(F.col("node_id").alias("source_node_id"), F.col("t").alias("source_tenant")), "source_node_id")
    e = e.join(n.select(F.col("node_id").alias("target_node_id"), F.col("t").alias("target_tenant")), "target_node_id")
    return e.filter("source_tenant <> target_tenant").select("edge_id", "source_tenant", "target_tenant")


@query("agg02_document_stats", """select doc_id, count(*) as n_nodes, max(depth)::bigint as max_depth, count_if(node_id not in (select parent_id from apex_ast_nodes where parent_id is not null)) as n_leaves
from apex_ast_nodes group by 1""")
def agg02(spark, d):
    n = nodes(spark, d)
    parents = n.filter("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.lit(1).alias("inner")).distinct()
    return n.join(parents, "node_id", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max("depth").cast("long").alias("max_depth"), F.count_if(F.col("inner").isNull()).alias("n_leaves"))


@query("agg03_node_counts", "select tenant_id, node_type, count(*) as n_nodes from apex_ast_nodes group by 1, 2")
def agg03(spark, d):
    return nodes(spark, d).groupBy("tenant_id", "node_type").agg(F.count(F.lit(1)).alias("n_nodes"))


@query("agg04_documents", "select distinct tenant_id, doc_id from apex_ast_nodes")
def agg04(spark, d):
    return nodes(spark, d).select("tenant_id", "doc_id").distinct()


@query("agg10_document_text", f"""with v as (select distinct doc_id, version_id, version_number, created_at, content from node_versions where {_IN.format(T1)})
select doc_id, version_id, md5(content) as digest, row_number() over w as part_no, coalesce(sum(length(coalesce(content, '')) + 2) over (partition by doc_id order by version_number, created_at, version_id, content rows between unbounded preceding and 1 preceding), 0)::bigint as start_pos
from v window w as (partition by doc_id order by version_number, created_at, version_id, content)""")
def agg10(spark, d):
    """The text of each document at an instant: its parts in order and where each begins, joined by blank lines. No document is put
    together in one place; a reader or writer takes the parts by offset."""
    v = versions(spark, d).filter(O.valid_at(T1, "effective_from", "effective_to")).select("doc_id", "version_id", "version_number", "created_at", "content").distinct()
    order = F.concat(F.lpad(F.col("version_number").cast("string"), 10, "0"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.coalesce("version_id", F.lit("")), F.lit("|"), F.coalesce("content", F.lit("")))
    v = v.withColumn("o", order).withColumn("one", F.lit(1)).withColumn("size", F.length(F.coalesce("content", F.lit(""))) + 2)
    v = running(v, "doc_id", "o", {"part_no": "one", "upto": "size"}, 17)
    return v.select("doc_id", "version_id", F.md5("content").alias("digest"), "part_no", (F.col("upto") - F.col("size")).alias("start_pos"))


@query("win01_latest_versions", """select node_id, max_by(version_id, (coalesce(is_current and validity_status = 'ACTIVE', false), version_number, version_id)) as version_id, count(*) as n_versions
from node_versions group by 1""")
def win01(spark, d):
    return T.top_version(versions(spark, d), prefer_active=True)


@query("win02_versions_at", f"select node_id, max_by(version_id, (version_number, version_id)) as version_id from node_versions where {_IN.format(T1)} group by 1")
def win02(spark, d):
    return T.version_at(versions(spark, d), T1)


_ORDER = "(partition by node_id order by version_number, version_id)"


@query("win03_version_chain", f"select distinct node_id, version_id, position from (select *, dense_rank() over {_ORDER} position from node_versions)")
def win03(spark, d):
    w = Window.partitionBy("node_id").orderBy("version_number", "version_id")
    return versions(spark, d).select("node_id", "version_id", F.dense_rank().over(w).cast("long").alias("position")).distinct()


_V1 = "v as (select distinct node_id, version_id, version_number, previous_version from node_versions)"


@query("win04_version_edges", f"""with {_V1} select version_id as source, node_id as target, 'VERSION_OF' as edge_type from v union
select version_id, lag(version_id) over {_ORDER} p, 'SUPERSEDES' from v qualify p is not null union
select version_id, previous_version, 'SNAPSHOT_OF' from v where previous_version is not null""")
def win04(spark, d):
    v = versions(spark, d).select("node_id", "version_id", "version_number", "previous_version").distinct()
    v = v.withColumn("before", F.lag("version_id").over(Window.partitionBy("node_id").orderBy("version_number", "version_id")))
    kinds = (("node_id", "VERSION_OF"), ("before", "SUPERSEDES"), ("previous_version", "SNAPSHOT_OF"))
    e = F.explode(F.array(*[F.struct(F.col(c).alias("target"), F.lit(k).alias("edge_type")) for c, k in kinds]))
    return v.select(F.col("version_id").alias("source"), e.alias("e")).select("source", "e.target", "e.edge_type").filter("target is not null").distinct()


@query("win05_successors", """with n as (select distinct doc_id, node_id, source_date from apex_ast_nodes where source_date is not null)
select doc_id, node_id as source, lead(node_id) over (partition by doc_id order by source_date, node_id) as target from n qualify target is not null""")
def win05(spark, d):
    """Each dated node's successor in its document, met by numbers, so a document with many nodes is no single window."""
    n = nodes(spark, d).filter("source_date is not null").select("doc_id", "node_id", "source_date").distinct()
    n = n.withColumn("o", F.concat(F.date_format("source_date", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("node_id")))
    n = materialise(numbered(n, "doc_id", "o", 7).select("doc_id", "node_id", "position"), "numbered")
    after = n.select("doc_id", F.col("node_id").alias("target"), (F.col("position") - 1).alias("position"))
    return n.join(after, ["doc_id", "position"]).select("doc_id", F.col("node_id").alias("source"), "target")


@query("win08_superseded_nodes", "select node_id, bool_or(superseded_by is not null) as superseded from apex_temporal_metadata group by 1")
def win08(spark, d):
    return table(spark, d, "apex_temporal_metadata").groupBy("node_id").agg(F.bool_or(F.col("superseded_by").isNotNull()).alias("superseded"))


@query("win09_version_status", f"select version_id, case when effective_to < timestamp '{NOW}' then 'EXPIRED' when is_current then 'ACTIVE' else 'SUPERSEDED' end as status from node_versions")
def win09(spark, d):
    return versions(spark, d).select("version_id", T.status_of(NOW).alias("status"))


@query("fn03_freshness", f"""select node_id, round(case when source_date is null or date_diff('day', source_date::date, date '{NOW}') <= 0 then 1.0
else exp(-decay_rate * date_diff('day', source_date::date, date '{NOW}')) end, 9) as freshness from apex_temporal_metadata""")
def fn03(spark, d):
    days = F.date_diff(F.lit(NOW).cast("date"), F.col("source_date").cast("date"))
    own = F.when(days > 0, F.exp(-F.col("decay_rate") * days)).otherwise(F.lit(1.0))
    return table(spark, d, "apex_temporal_metadata").select("node_id", F.round(own, 9).alias("freshness"))


@query("fn04_half_life", "select decay_rate, round(ln(2) / decay_rate, 6) as half_life, count(*) as n from apex_temporal_metadata where decay_rate > 0 group by 1, 2")
def fn04(spark, d):
    m = table(spark, d, "apex_temporal_metadata").filter("decay_rate > 0")
    return m.groupBy("decay_rate", F.round(T.half_life(F.col("decay_rate")), 6).alias("half_life")).agg(F.count(F.lit(1)).alias("n"))


@query("fn13_content_hash", "select version_id, sha256(content) as digest from node_versions")
def fn13(spark, d):
    return versions(spark, d).select("version_id", F.sha2("content", 256).alias("digest"))


@query("fn14_content_integrity", "select validity_status, coalesce(content_hash = sha256(content), false) as intact, count(*) as n_rows from node_versions group by 1, 2")
def fn14(spark, d):
    ok = F.coalesce(F.col("content_hash") == F.sha2("content", 256), F.lit(False))
    return versions(spark, d).groupBy("validity_status", ok.alias("intact")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("fn29_edge_metadata", f"with {EDGES} select edge_id, try_cast(metadata::json ->> '$.page' as bigint) as page, array_to_string(projections, ',') as projections from e")
def fn29(spark, d):
    page = F.get_json_object("metadata", "$.page").try_cast("bigint")
    return edges(spark, d).select("edge_id", page.alias("page"), F.array_join("projections", ",").alias("projections"))


@query("set04_version_text_diff", """with v as (select distinct node_id, version_id, version_number, content from node_versions),
p as (select version_id, string_split(content, chr(10)) b, string_split(lag(content) over (partition by node_id order by version_number, version_id), chr(10)) a from v)
select version_id, len(list_filter(b, lambda x: not list_contains(a, x))) as n_added, len(list_filter(a, lambda x: not list_contains(b, x))) as n_removed from p where a is not null""")
def set04(spark, d):
    v = versions(spark, d).select("node_id", "version_id", "version_number", "content").distinct()
    v = v.withColumn("old", F.lag("content").over(Window.partitionBy("node_id").orderBy("version_number", "version_id"))).filter("old is not null")
    added, removed = T.line_diff(F.col("old"), F.col("content"))
    return v.select("version_id", F.size(added).cast("long").alias("n_added"), F.size(removed).cast("long").alias("n_removed"))


@query("snk09_scd2_write", """with v as (select distinct node_id, version_id, effective_from f, content from node_versions where effective_from is not null)
select version_id, row_number() over w as version_no, lag(version_id) over w as previous_version, coalesce(epoch_us(lead(f) over w), -1) as to_us, lead(f) over w is null as is_current
from v window w as (partition by node_id order by f, version_id, content)""")
def snk09(spark, d):
    """Numbers, links and ends of versions written one after the other."""
    v = versions(spark, d).filter("effective_from is not null").select("node_id", "version_id", "effective_from", "content").distinct()
    w = Window.partitionBy("node_id").orderBy("effective_from", "version_id", "content")
    nxt = F.lead("effective_from").over(w)
    return v.select("version_id", F.row_number().over(w).cast("long").alias("version_no"), F.lag("version_id").over(w).alias("previous_version"),
        F.coalesce(micros(nxt), F.lit(-1).cast("long")).alias("to_us"), nxt.isNull().alias("is_current"))


@query("gen13_structural_edges", """with n as (select distinct node_id, parent_id from apex_ast_nodes where parent_id is not null)
select p.node_id as source, n.node_id as target, 'REFINES' as edge_type from n join (select distinct node_id from apex_ast_nodes) p on p.node_id = n.parent_id
union all select a.node_id, b.node_id, 'SUPPORTS' from n a join n b on a.parent_id = b.parent_id and a.node_id < b.node_id""")
def gen13(spark, d):
    """Parent to child, and each two siblings: the pairs are the result itself here."""
    n = nodes(spark, d).filter("parent_id is not null").select("node_id", "parent_id").distinct()
    p = nodes(spark, d).select(F.col("node_id").alias("parent_id")).distinct()
    down = n.join(p, "parent_id").select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.lit("REFINES").alias("edge_type"))
    other = n.select("parent_id", F.col("node_id").alias("target"))
    pairs = n.join(other, "parent_id").filter("node_id < target").select(F.col("node_id").alias("source"), "target", F.lit("SUPPORTS").alias("edge_type"))
    return down.unionByName(pairs)


@query("fn11_structurally_related", f"""with {EDGES}, n as (select node_id, max(parent_id) p from apex_ast_nodes group by 1)
select edge_id, coalesce(a.p = b.node_id, false) or coalesce(b.p = a.node_id, false) or coalesce(a.p = b.p, false) as related from e join n a on a.node_id = source_node_id join n b on b.node_id = target_node_id""")
def fn11(spark, d):
    n = nodes(spark, d).groupBy("node_id").agg(F.max("parent_id").alias("p"))
    e = edges(spark, d).select("edge_id", "source_node_id", "target_node_id")
    e = e.join(n.select(F.col("node_id").alias("source_node_id"), F.col("p").alias("a")), "source_node_id")
    e = e.join(n.select(F.col("node_id").alias("target_node_id"), F.col("p").alias("b")), "target_node_id")
    tests = [F.col("a") == F.col("target_node_id"), F.col("b") == F.col("source_node_id"), F.col("a") == F.col("b")]
    no = F.lit(False)
    return e.select("edge_id", (F.coalesce(tests[0], no) | F.coalesce(tests[1], no) | F.coalesce(tests[2], no)).alias("related"))


@query("set06_merged_edges", f"""with n as (select distinct node_id, parent_id, doc_id, source_date from apex_ast_nodes), a as (select parent_id s, node_id t, 'REFINES' k, 1 r from n where parent_id is not null),
b as (select source_node_id s, target_node_id t, edge_type k, 2 r from apex_causal_edges where source_node_id is not null and target_node_id is not null)
select s as source, t as target, k as edge_type, min(r)::bigint as strategy from (from a union all from b) group by 1, 2, 3""")
def set06(spark, d):
    """Edges of several strategies, each (source, target, type) once, from the first strategy that has it."""
    n = nodes(spark, d).filter("parent_id is not null").select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), F.lit("REFINES").alias("edge_type"), F.lit(1).alias("r"))
    e = table(spark, d, "apex_causal_edges").filter("source_node_id is not null and target_node_id is not null")
    e = e.select(F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target"), "edge_type", F.lit(2).alias("r"))
    return n.unionByName(e).groupBy("source", "target", "edge_type").agg(F.min("r").cast("long").alias("strategy"))


@query("grf18_lineage_rows", "select node_id, version_id, row_number() over (partition by node_id order by created_at desc, version_id, updated_at desc, content) as position from (select distinct node_id, version_id, created_at, updated_at, content from node_versions)")
def grf18(spark, d):
    w = Window.partitionBy("node_id").orderBy(F.desc("created_at"), "version_id", F.desc("updated_at"), "content")
    v = versions(spark, d).select("node_id", "version_id", "created_at", "updated_at", "content").distinct()
    return v.select("node_id", "version_id", F.row_number().over(w).cast("long").alias("position"))


@query("qry11_explain_nodes", f"""with {EDGES}, o as (select source_node_id k, count(*) c from e group by 1), i as (select target_node_id k, count(*) c from e group by 1), m as (select node_id k, max(version_number)::bigint v from apex_temporal_metadata group by 1)
select n.node_id, any_value(coalesce(o.c, 0)) as n_out, any_value(coalesce(i.c, 0)) as n_in, any_value(m.v) as version_number from apex_ast_nodes n left join o on o.k = n.node_id left join i on i.k = n.node_id left join m on m.k = n.node_id group by 1""")
def qry11(spark, d):
    n = nodes(spark, d).select("node_id").distinct()
    out = edges(spark, d).groupBy(F.col("source_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges(spark, d).groupBy(F.col("target_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
    m = table(spark, d, "apex_temporal_metadata").groupBy("node_id").agg(F.max("version_number").cast("long").alias("version_number"))
    zero = F.lit(0).cast("long")
    j = n.join(out, "node_id", "left").join(into, "node_id", "left").join(m, "node_id", "left")
    return j.select("node_id", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"), "version_number")
