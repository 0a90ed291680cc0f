"""Smaller queries: flags, deletes, prefixes, phrase search, patches, sibling similarity, histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.operators import extract as X
from strataleaf.operators import facts as O
from strataleaf.operators import graph as G
from strataleaf.operators import likeness as L
from strataleaf.operators import search as R
from strataleaf.operators import sinks
from strataleaf.operators.components import components
from strataleaf.operators.hierarchy import latest_nodes
from strataleaf.plans import core_sql
from strataleaf.plans.base import Registry
from strataleaf.plans.q_facts import _AT, _CHAIN, _CONFLICT, _DELTA, FLAWED90, D90, LEAD, STEPS, T0, T1, _flawed, facts
from strataleaf.plans.q_graph import _BFS, EMBEDDED, _roots, edges, likeness_sql
from strataleaf.plans.q_text import _tok
from strataleaf.sources.tables import table

query = Registry()


def nodes(spark, d):
    return table(spark, d, "apex_ast_nodes")


@query("src14_leaf_flags", "select distinct node_id, node_id not in (select parent_id from apex_ast_nodes where parent_id is not null) and trim(content) <> '' as is_leaf from apex_ast_nodes")
def src14(spark, d):
    inner = nodes(spark, d).filter("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.lit(True).alias("inner")).distinct()
    n = nodes(spark, d).select("node_id", "content").join(inner, "node_id", "left")
    return n.select("node_id", (F.col("inner").isNull() & (F.trim("content") != "")).alias("is_leaf")).distinct()


@query("snk14_export", core_sql.TREE.replace("@", """select coalesce(t.root, 'cycle') as root_id, l.node_id, coalesce(t.lv, -1) as level_no, n.node_type, md5(n.content) as digest from l join n on n.k = l.k left join t on t.k = l.k"""))
def snk14(spark, d):
    """Trees as lines of JSON, a node each, read again for what they say."""
    json = lambda f: F.get_json_object("json", f"$.{f}")
    return sinks.exported(nodes(spark, d)).select("root_id", "node_id", "level_no", json("node_type").alias("node_type"), F.md5(json("content")).alias("digest"))


@query("joi07_all_anomalies", f"""{FLAWED90} select kind, count(*) as n from (select kind from ({_CONFLICT}) union all select 'BROKEN_LINK' from (select tenant_id, unnest([parent_fact_id, superseded_by]) target from facts) l
where target is not null and not exists (select 1 from facts f where f.tenant_id = l.tenant_id and f.fact_id = l.target) union all select 'CHAIN_OVERLAP' from ({_CHAIN})) group by 1""")
def joi07(spark, d):
    f = _flawed(facts(spark, d, 90))
    kinds = O.conflicts(f).select("kind").unionByName(O.broken_links(f).select(F.lit("BROKEN_LINK").alias("kind"))).unionByName(O.chain_overlaps(f).select(F.lit("CHAIN_OVERLAP").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("agg01_section_stats", "select doc_id, count(*) as n_sections, max(depth)::bigint as max_depth, sum((content = '')::int)::bigint as n_blank from apex_ast_nodes where node_type = 'HEADING' group by 1")
def agg01(spark, d):
    h = nodes(spark, d).filter("node_type = 'HEADING'").groupBy("doc_id")
    return h.agg(F.count(F.lit(1)).alias("n_sections"), F.max("depth").cast("long").alias("max_depth"), F.count_if(F.col("content") == "").alias("n_blank"))


def compiled(query_text: str, column: str):
    """One word: a word begins with it; several: the phrase stands in the text; without case. Blank: nothing."""
    words = query_text.split()
    if not words:
        return F.lit(False)
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    if len(words) == 1:
        return F.exists(F.split(low, r"[^a-z0-9]+"), lambda w: w.startswith(words[0].lower()))
    return F.contains(low, F.lit(" ".join(words).lower()))


@query("srt03_phrase_and_prefix", r"""select doc_id, contains(lower(coalesce(text, '')), 'retention schedule') as phrase, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: starts_with(w, 'certif'))) > 0 as prefix from documents""")
def srt03(spark, d):
    return table(spark, d, "documents").select("doc_id", compiled("Retention schedule", "text").alias("phrase"), compiled("Certif", "text").alias("prefix"))


@query("set02_apply_deltas", f"{D90} select tenant_id, doc_id, fact_id from facts where {_AT.format(STEPS[-1])}")
def set02(spark, d):
    """A base state with a row of deltas applied: the last change of each fact decides."""
    f = facts(spark, d, 90)
    last = O.delta_range(f, STEPS).groupBy(*O.DOC, "fact_id").agg(F.max_by("change", "step").alias("change"))
    base = f.filter(O.valid_at(STEPS[0])).select(*O.DOC, "fact_id")
    return base.join(last.filter("change = 'removed'"), [*O.DOC, "fact_id"], "left_anti").unionByName(last.filter("change = 'added'").drop("change")).distinct()


@query("set07_patches", f"{D90}, x as ({_DELTA.format(_AT.format(T0), _AT.format(T1))}) select tenant_id, doc_id, count_if(change = 'added') as n_added, count_if(change = 'removed') as n_removed, min(fact_id) as first_fact from x group by 1, 2")
def set07(spark, d):
    x = O.delta(facts(spark, d, 90), T0, T1).groupBy(*O.DOC)
    return x.agg(F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "removed").alias("n_removed"), F.min("fact_id").alias("first_fact"))


@query("set08_unmatched_words", f"with q as (select distinct unnest({_tok('question')}) term from eval_items), d as (select distinct unnest({_tok('text')}) term from documents) select term from q where term not in (from d)")
def set08(spark, d):
    """Words of the questions that no document has."""
    asked = table(spark, d, "eval_items").select(F.explode(R.tokens(F.col("question"))).alias("term")).distinct()
    return asked.join(table(spark, d, "documents").select(F.explode(R.tokens(F.col("text"))).alias("term")).distinct(), "term", "left_anti")


@query("fn05_touching_windows", """with v as (select distinct node_id, version_id, effective_from f, effective_to t from node_versions where effective_from is not null), w as (select *, lag(f) over x pf, lag(t) over x pt from v window x as (partition by node_id order by f, version_id, t nulls first))
select version_id, coalesce(epoch_us(t), -1) as to_us, pf <= coalesce(t, timestamp '9999-12-31') and coalesce(pt, timestamp '9999-12-31') > f as overlaps_before from w where pf is not null""")
def fn05(spark, d):
    v = table(spark, d, "node_versions").filter("effective_from is not null").select("node_id", "version_id", F.col("effective_from").alias("f"), F.col("effective_to").alias("t")).distinct()
    w = Window.partitionBy("node_id").orderBy("f", "version_id", F.asc_nulls_first("t"))
    v = v.withColumn("pf", F.lag("f").over(w)).withColumn("pt", F.lag("t").over(w)).filter("pf is not null")
    hit = O.overlaps(F.col("pf"), F.col("pt"), F.col("f"), F.col("t"))
    return v.select("version_id", F.coalesce(micros("t"), F.lit(-1).cast("long")).alias("to_us"), hit.alias("overlaps_before"))


_WORDS4 = "[w for w in regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+') if regexp_full_match(w, '[a-z]{{4,}}')]"
_DENIES = " or ".join(f"coalesce(regexp_matches(lower({c}), $r${p}$r$), false)" for p in X.NEGATIONS for c in ("xc", "yc"))
_DENIED = f"with {EMBEDDED}, q as (select * from pr where cos > 0.65 and xs <> ys and len(list_intersect({_WORDS4.format('xc')}, {_WORDS4.format('yc')})) > 0 and ({_DENIES}))"


@query("fn23_similar_nodes", likeness_sql("cos > 0.65", "xs <> ys"))
def fn23_all(spark, d):
    """Each embedded node's class of like nodes of its document and with how many of another text it is like."""
    return L.like_nodes(L.embedded(nodes(spark, d)), 0.65, texts_differ=True)


@query("grf19_clusters", f"select k as n_nodes, count(*) as n_clusters from (select count(*) k from (select coalesce(class_id, node_id) c from (select distinct lower(trim(node_id, ' ')) node_id from apex_ast_nodes where trim(node_id, ' ') <> '') left join ({likeness_sql('cos > 0.65')}) using (node_id)) group by c) group by 1")
def grf19_all(spark, d):
    """Single-linkage clusters over all nodes of a document, by size; a node without an embedding is one of its own."""
    c = L.like_nodes(L.embedded(nodes(spark, d)), 0.65).select("node_id", "class_id")
    every = latest_nodes(nodes(spark, d), "doc_id").select(F.col("key").alias("node_id")).join(c, "node_id", "left")
    sizes = every.groupBy(F.coalesce("class_id", "node_id").alias("class_id")).agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_clusters"))


@query("grf20_contradictions", f"{_DENIED} select x, y from q")
def grf20_all(spark, d):
    """Like nodes of a document that share a word of four letters or more, of which one denies something."""
    return L.contradicting(L.embedded(nodes(spark, d))).select("x", "y")


@query("grf21_dated_overrides", f"{_DENIED} select case when xd >= yd then x else y end as newer, case when xd >= yd then y else x end as older from q where xd is not null and yd is not null")
def grf21_all(spark, d):
    """Of two dated nodes that contradict each other the newer overrides the older; at one date the first by id counts as newer."""
    c = L.contradicting(L.embedded(nodes(spark, d)).filter("dated is not null")).withColumn("first", F.expr("x_dated >= y_dated"))
    return c.select(F.when(F.col("first"), F.col("x")).otherwise(F.col("y")).alias("newer"), F.when(F.col("first"), F.col("y")).otherwise(F.col("x")).alias("older"))


@query("grf02_hops_to_entities", f"select node, hops from ({_BFS.format(4)}) where starts_with(node, 'entity:')")
def grf02(spark, d):
    e = edges(spark, d).filter(~F.col("k").isin("CONTRADICTS", "OVERRIDES"))
    return G.hops(G.undirected(e, "s", "t"), _roots(spark, d), 4).filter(F.col("node").startswith("entity:"))


@query("grf11_history_sizes", f"{LEAD} select fact_id, count(*) over (partition by tenant_id, doc_id, subject) as n_facts from facts")
def grf11(spark, d):
    return facts(spark, d).select("fact_id", F.count(F.lit(1)).over(Window.partitionBy(*O.SUBJECT)).alias("n_facts"))


@query("gen18_trace_edges", "select lag(event_id) over (partition by user_id order by ts, event_id) as source, event_id as target, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 'INFERS' else 'DERIVES_FROM' end as edge_type from events qualify source is not null")
def gen18(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == F.lag("event_type").over(w), "INFERS").otherwise("DERIVES_FROM")
    return table(spark, d, "events").select(F.lag("event_id").over(w).alias("source"), F.col("event_id").alias("target"), kind.alias("edge_type")).filter("source is not null")


@query("str06_snapshot_manifests", "select user_id, date_trunc('day', ts)::date as day, count(*) as n_rows, max(event_id) as last_event from events group by 1, 2")
def str06(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("event_id").alias("last_event"))


@query("fn31_tenant_keys", "select tenant_id || ':' || doc_id as key, count(*) as n_nodes from apex_ast_nodes group by 1")
def fn31(spark, d):
    return nodes(spark, d).groupBy(F.concat_ws(":", "tenant_id", "doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n_nodes"))
