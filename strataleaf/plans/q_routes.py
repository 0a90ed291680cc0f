"""Queries over questions: what they ask for, how they are answered over time, and references to headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.operators import extract as X
from strataleaf.operators import facts as O
from strataleaf.operators import routes as R
from strataleaf.operators.search import top_k
from strataleaf.plans.base import Registry
from strataleaf.plans.q_facts import _AT, _STATE, D90, T0, T1, facts
from strataleaf.plans.q_text import re2
from strataleaf.sources.tables import table
from strataleaf.streaming import jobs as J

query = Registry()


def texts(spark, d):
    """Questions, and documents as what might be asked."""
    q = table(spark, d, "eval_items").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("question").alias("text"), "domain")
    return q.unionByName(table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text", F.col("source").alias("domain")))


TEXTS = "t as (select 'q' || item_id id, question as text, domain from eval_items union all select 'd' || doc_id, text, source from documents)"


def _bordered(pattern: str) -> str:
    """A word border as the twin's engine has to be told it: there the text begins or ends, or no letter, digit or _ stands."""
    head = pattern.startswith(r"\b")
    body = pattern[2:] if head else pattern
    tail = body.endswith(r"\b")
    body = body[:-2] if tail else body
    return (r"(?:^|[^\p{L}\p{N}_])" if head else "") + f"(?:{re2(body)})" + (r"(?:$|[^\p{L}\p{N}_])" if tail else "")


def _any(patterns: list[str]) -> str:
    return f"coalesce(regexp_matches(text, $r$(?i){'|'.join(map(_bordered, patterns))}$r$), false)"


QUESTIONS = "t as (select 'q' || item_id id, question as text, domain from eval_items)"


def questions(spark, d):
    return texts(spark, d).filter(F.col("id").startswith("q"))


@query("fn18_time_questions", f"with {TEXTS} select id, {_any(R.TIME_WORDS)} as about_time from t")
def fn18(spark, d):
    return texts(spark, d).select("id", R.any_of(F.col("text"), R.TIME_WORDS).alias("about_time"))


@query("fn20_routes", f"with {TEXTS} select id, " + ", ".join(f"{_any(p)}{x} as {k}" for (k, p), x in zip(R.SIGNALS.items(), ("", "", " or coalesce(upper(domain) in ('LEGAL', 'FINANCIAL', 'COMPLIANCE'), false)"), strict=True)) + " from t")
def fn20(spark, d):
    """By the words and, as a planner's type, the domain."""
    need = R.projections(F.col("text"), F.upper("domain"))
    return texts(spark, d).select("id", *[c.alias(k) for k, c in need.items()])


_word = lambda n: n if n == "may" else f"(?:{n}|{n[:3]})"
_MONTH = " || ".join(
    rf"case when regexp_matches(low, '\b{_word(n)}\b') then [try_cast(coalesce(nullif(regexp_extract(low, '\b{_word(n)}\s+(20\d{{2}})\b', 1), ''), '2025') || '-{k:02}-01' as date)] else [] end" for k, n in enumerate(R._MONTHS, 1))
DATES = rf"""l as (select *, lower(coalesce(text, '')) low from t), i as (select *, regexp_extract_all(low, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1) iso from l),
a as (select *, [try_cast(x as date) for x in iso] || [try_cast(y || '-01-01' as date) for y in regexp_extract_all(low, '\b(20[23]\d)\b', 1) if len([z for z in iso if contains(z, y)]) = 0] || {_MONTH} || [make_date(2025, q::int * 3 - 2, 1) for q in regexp_extract_all(low, '\bq([1-4])\b', 1)] ds from i),
dt as (select * exclude ds, list_sort(list_distinct([x for x in ds if x is not null])) ds from a)"""


@query("fn17_question_dates", f"with {QUESTIONS}, {DATES} select id, array_to_string([x::varchar for x in ds], ' ') as dates from dt")
def fn17(spark, d):
    return questions(spark, d).select("id", F.array_join(F.transform(R.parsed_dates(F.col("text")), lambda x: x.cast("string")), " ").alias("dates"))


@query("fn19_temporal_modes", f"""with {QUESTIONS}, {DATES}, x as (select *, {_any(R.TIME_WORDS)} tm from dt)
select id, case when tm and (contains(low, 'trend') or contains(low, 'growth')) then 'TREND' when len(ds) >= 2 or contains(low, 'between') then 'BETWEEN' when len(ds) = 1 then 'AS_OF' when tm then 'LATEST' end as mode from x where text is not null""")
def fn19(spark, d):
    t = questions(spark, d).filter("text is not null")
    about = R.any_of(F.col("text"), R.TIME_WORDS)
    return t.select("id", R.temporal_mode(F.col("text"), R.parsed_dates(F.col("text")), about, about).alias("mode"))


@query("qry06_temporal_answers", f"""with {QUESTIONS}, {DATES}, m as (select id, low, case when contains(low, 'trend') or contains(low, 'growth') then 'TREND' when (contains(low, 'change') or contains(low, 'compare') or contains(low, 'diff')) and len(ds) >= 2 then 'CHANGE_DETECTION' when len(ds) >= 1 then 'AS_OF_DATE' else 'LATEST' end as mode, ds from dt),
v as (select distinct node_id, effective_from f, coalesce(effective_to, timestamp '9999-12-31') e from node_versions where effective_from is not null),
u as (select id, mode, case when mode = 'CHANGE_DETECTION' then ds[1] when mode = 'AS_OF_DATE' then ds[1] end d1, case when mode = 'CHANGE_DETECTION' then ds[2] end d2 from m),
dd as (select distinct unnest([d1, d2]) d from u), n as (select d, count(distinct node_id) c from dd join v on f <= d and e > d where d is not null group by 1)
select id, mode, d1::varchar as first_date, d2::varchar as second_date, coalesce(a.c, case when d1 is not null then 0 end) as n_first, coalesce(b.c, case when d2 is not null then 0 end) as n_second,
case mode when 'LATEST' then (select count(distinct node_id) from node_versions where is_current) when 'TREND' then (select count(*) from events) end as n_now from u left join n a on a.d = d1 left join n b on b.d = d2""")
def qry06(spark, d):
    """Each question's way of answering and what it is answered from: nodes with a version at the one or two instants,
    current nodes, or the timeline's events."""
    q = questions(spark, d)
    q = q.withColumn("dates", R.parsed_dates(F.col("text"))).withColumn("mode", R.answer_mode(F.coalesce("text", F.lit("")), F.col("dates")))
    one = F.col("mode").isin("CHANGE_DETECTION", "AS_OF_DATE")
    q = q.select("id", "mode", F.when(one, F.get("dates", 0)).alias("d1"), F.when(F.col("mode") == "CHANGE_DETECTION", F.get("dates", 1)).alias("d2"))
    v = table(spark, d, "node_versions").filter("effective_from is not null")
    at = q.select(F.explode(F.array("d1", "d2")).alias("d")).filter("d is not null").distinct()
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    # a question names few dates: their number is bounded by the questions', not by the versions'
    hit = v.join(at, (F.col("effective_from") <= F.col("d")) & (F.coalesce("effective_to", far) > F.col("d"))).groupBy("d").agg(F.countDistinct("node_id").alias("c"))
    now = v.sparkSession.read.parquet(f"{d}/node_versions.parquet").filter("is_current").agg(F.countDistinct("node_id").alias("n_current"))
    events = table(spark, d, "events").agg(F.count(F.lit(1)).alias("n_events"))
    j = q.join(hit.select(F.col("d").alias("d1"), F.col("c").alias("c1")), "d1", "left").join(hit.select(F.col("d").alias("d2"), F.col("c").alias("c2")), "d2", "left")
    j = j.crossJoin(F.broadcast(now)).crossJoin(F.broadcast(events))  # two rows of totals
    zero = lambda c, day: F.coalesce(F.col(c), F.when(F.col(day).isNotNull(), F.lit(0).cast("long")))
    return j.select("id", "mode", F.col("d1").cast("string").alias("first_date"), F.col("d2").cast("string").alias("second_date"), zero("c1", "d1").alias("n_first"), zero("c2", "d2").alias("n_second"),
        F.when(F.col("mode") == "LATEST", F.col("n_current")).when(F.col("mode") == "TREND", F.col("n_events")).alias("n_now"))


@query("str12_gating", """select m as mode, p as projection, case when m = 'eager' then true else p = 'document' end as eager, m = 'adaptive' and p in ('entity', 'citation', 'policy') as lazy
from unnest(['eager', 'adaptive', 'minimal']) a(m), unnest(['document', 'entity', 'citation', 'policy', 'fact', 'reasoning', 'temporal', 'version']) b(p)""")
def str12(spark, d):
    cells = [(m, p) for m in ("eager", "adaptive", "minimal") for p in (*R.EAGER, *R.LAZY, *R.DEFERRED)]
    eager, lazy = R.built(F.col("mode"), F.col("projection"))
    return spark.createDataFrame(cells, "mode string, projection string").select("mode", "projection", eager.alias("eager"), lazy.alias("lazy"))


@query("fn28_policies", """select * from (values ('factual', 3, 0.9::double, false, false), ('analytical', 5, 0.7, true, true), ('legal', 7, 0.95, true, false), ('financial', 5, 0.95, true, true), ('code', 10, 0.8, true, true)) t(mode, max_depth, strictness, backtracking, hybrid)""")
def fn28(spark, d):
    return spark.createDataFrame([(m,) for m in R.POLICIES], "mode string").select("mode", R.policy(F.col("mode")).alias("p")).select("mode", "p.*")


_XREF = X.PATTERNS["cross_reference"][0]


@query("fn25_resolved_references", rf"""with n as (select distinct doc_id, node_id, content, node_type from apex_ast_nodes), r as (select distinct doc_id, node_id, unnest(regexp_extract_all(content, $r${_XREF}$r$, 1)) ref from n),
c as (select *, lower(trim(regexp_replace(ref, '^(?i:§|section|sec\.|chapter|ch\.|appendix|fig\.|table|figure)', ''))) k from r), h as (select doc_id, node_id hid, lower(trim(content)) title from n where node_type = 'HEADING' and trim(content) <> '')
select c.doc_id, c.node_id, c.ref, (select min(hid) from h where h.doc_id = c.doc_id and k <> '' and (starts_with(title, k) or starts_with(k, title))) as target from c""")
def fn25(spark, d):
    """References to headings of the same document: equal, or one begins with the other. Met by equal prefixes: a reference is short,
    so each title has few prefixes of its length, and the joins stay equi-joins."""
    n = table(spark, d, "apex_ast_nodes").select("doc_id", "node_id", "content", "node_type").distinct()
    refs = n.select("doc_id", "node_id", F.explode(F.regexp_extract_all("content", F.lit(f"(?Ud){_XREF}"), F.lit(1))).alias("ref")).distinct()
    refs = refs.withColumn("k", R.reference_key(F.col("ref")))
    h = n.filter("node_type = 'HEADING'").select("doc_id", F.col("node_id").alias("hid"), F.lower(F.trim("content")).alias("title")).filter("title <> ''")
    h = h.groupBy("doc_id", "title").agg(F.min("hid").alias("hid"))
    longest = refs.agg(F.coalesce(F.max(F.length("k")), F.lit(0))).first()[0]
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(c), F.lit(max(longest, 1))), F.lit(1))), lambda i: F.substring(c, F.lit(1), i))
    begins = h.select("doc_id", F.explode(prefixes(F.col("title"))).alias("k"), "hid").groupBy("doc_id", "k").agg(F.min("hid").alias("t1"))
    keys = refs.select("doc_id", "k").filter("k <> ''").distinct()
    within = keys.select("doc_id", "k", F.explode(prefixes(F.col("k"))).alias("title")).join(h, ["doc_id", "title"]).groupBy("doc_id", "k").agg(F.min("hid").alias("t2"))
    out = refs.join(begins, ["doc_id", "k"], "left").join(within, ["doc_id", "k"], "left")
    return out.select("doc_id", "node_id", "ref", F.when(F.col("k") != "", F.least("t1", "t2")).alias("target"))


@query("grf15_authoritative_at", f"""with v as (select distinct node_id, version_id, version_number from node_versions where effective_from <= timestamp '{T1}' and (effective_to is null or effective_to > timestamp '{T1}'))
select node_id, version_id from (select *, row_number() over (partition by node_id order by version_number desc, version_id desc) r from v) where r = 1""")
def grf15(spark, d):
    """Of the versions in force at an instant the one with the greatest number (tie: id)."""
    v = table(spark, d, "node_versions").filter(f"effective_from <= timestamp_ntz '{T1}' and (effective_to is null or effective_to > timestamp_ntz '{T1}')")
    return v.groupBy("node_id").agg(F.max(F.struct("version_number", "version_id")).alias("v")).select("node_id", "v.version_id")


@query("str04_snapshots", f"""{D90}, p as (select *, true persisted from ({_STATE.format(_AT.format(T0))}) where tenant_id < 'F'), docs as (select distinct tenant_id, doc_id from p),
c as (select *, false persisted from ({_STATE.format(_AT.format(T1))}) where (tenant_id, doc_id) not in (from docs)) select tenant_id, doc_id, subject, fact_id, persisted from p union all select tenant_id, doc_id, subject, fact_id, persisted from c""")
def str04(spark, d):
    """The state of each document at an instant: as the newest snapshot that was kept before has it, even if it is stale, else computed."""
    f = facts(spark, d, 90)
    kept = O.state_at(f, T0).filter("tenant_id < 'F'").select(*O.SUBJECT, "fact_id")
    fresh = O.state_at(f, T1).select(*O.SUBJECT, "fact_id").join(kept.select(*O.DOC).distinct(), list(O.DOC), "left_anti")
    return kept.withColumn("persisted", F.lit(True)).unionByName(fresh.withColumn("persisted", F.lit(False)))


@query("srt16_cached_queries", """with c as (select item_id, domain doc_id, lower(trim(question)) q, row_number() over (partition by domain order by item_id desc) newest from eval_items),
a as (select item_id, domain doc_id, lower(trim(case when item_id % 3 = 0 then question when item_id % 3 = 1 then left(question, 30) else question || ' please' end)) q from eval_items),
e as (select a.item_id, max(c.item_id) hit from a join c on a.doc_id = c.doc_id and a.q = c.q group by 1), s as (select a.item_id, max(c.item_id) hit from a join c on a.doc_id = c.doc_id and newest <= 100 and (contains(c.q, a.q) or contains(a.q, c.q)) group by 1)
select a.item_id, coalesce(e.hit, s.hit) as hit, e.hit is not null as exact from a left join e using (item_id) left join s using (item_id)""")
def srt16(spark, d):
    """The cached query that answers each asked one: the same text, else the newest of the document's last 100 of which one text is part
    of the other. The 100 are the operator's own limit, so a question meets at most so many."""
    q = table(spark, d, "eval_items").select("item_id", F.col("domain").alias("doc_id"), "question")
    cached = q.select(F.col("item_id").alias("hit"), "doc_id", F.lower(F.trim("question")).alias("c"))
    form = F.when(F.col("item_id") % 3 == 0, F.col("question")).when(F.col("item_id") % 3 == 1, F.substring("question", 1, 30)).otherwise(F.concat("question", F.lit(" please")))
    asked = q.select("item_id", "doc_id", F.lower(F.trim(form)).alias("q"))
    exact = asked.join(cached, (asked["doc_id"] == cached["doc_id"]) & (asked["q"] == cached["c"])).groupBy("item_id").agg(F.max("hit").alias("e"))
    newest = top_k(cached, ["doc_id"], 100, F.desc("hit")).drop("position")
    part = asked.join(newest, "doc_id").filter(F.contains("c", F.col("q")) | F.contains("q", F.col("c"))).groupBy("item_id").agg(F.max("hit").alias("s"))
    out = asked.join(exact, "item_id", "left").join(part, "item_id", "left")
    return out.select("item_id", F.coalesce("e", "s").alias("hit"), F.col("e").isNotNull().alias("exact"))


@query("str08_ttl_hits", """with recursive g as (select user_id, event_type, event_id, epoch_us(ts) us, row_number() over (partition by user_id, event_type order by ts, event_id) n from events),
w as (select user_id, event_type, event_id, n, us set_us, false hit from g where n = 1 union all
select g.user_id, g.event_type, g.event_id, g.n, case when g.us - w.set_us < 21600000000 then w.set_us else g.us end, g.us - w.set_us < 21600000000 from w join g on g.user_id = w.user_id and g.event_type = w.event_type and g.n = w.n + 1)
select event_id, hit from w""")
def str08(spark, d):
    """Reads of a cache of which an entry lives six hours from when it was set: a miss sets it."""
    e = J.read(spark, f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("entry"), micros("ts").alias("us"))
    return J.run_available(J.cached_reads(e, 6 * 3_600_000_000), "cache").select(F.col("id").alias("event_id"), "hit")


_SUFFIXES = "['k', 'K', 'm', 'M', 'b', 'B', 'l', 'L', 'cr', 'Cr', 'CR', 't', '']"


@query("fn02_multipliers", f"""select x as suffix, i as indian, case when lower(x) = 'k' then 1e3 when lower(x) = 'm' then 1e6 when lower(x) = 'b' then 1e9 when i and lower(x) = 'l' then 1e5 when i and lower(x) = 'cr' then 1e7 else 1.0 end::double as times
from unnest({_SUFFIXES}) a(x), unnest([true, false]) b(i)""")
def fn02(spark, d):
    """What each suffix of an amount multiplies by, after ₹ and after other signs."""
    cells = [(x, i) for x in ("k", "K", "m", "M", "b", "B", "l", "L", "cr", "Cr", "CR", "t", "") for i in (True, False)]
    return spark.createDataFrame(cells, "suffix string, indian boolean").select("suffix", "indian", X.multiplier(F.col("suffix"), F.col("indian")).alias("times"))
