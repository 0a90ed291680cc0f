"""Queries over measurements: events as a timeline and change log, line items as scored packets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.operators import stats as S
from strataleaf.operators import temporal as T
from strataleaf.plans.base import Registry
from strataleaf.sources.tables import table

query = Registry()
_Q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def events(spark, d):
    return table(spark, d, "events")


def packets(spark, d):
    """A line item as a retrieved packet: its order the question, the discount the score's complement."""
    li = table(spark, d, "lineitem")
    n = F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    return li.select(
        F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("rank"), n.alias("max_rank"), F.col("l_returnflag").alias("domain"),
        F.round(1 - F.col("l_discount") - F.col("l_tax"), 4).alias("retrieval"), (F.col("l_linestatus") == "O").alias("verified"),
    )


PACKETS = """p as (select l_orderkey q, l_linenumber rank, count(*) over (partition by l_orderkey) max_rank, l_returnflag "domain", round(1 - l_discount - l_tax, 4) retrieval,
l_linestatus = 'O' verified from lineitem), s as (select *, round(0.40 * (1 - retrieval) + 0.35 * (case when verified then 0.0 else 1.0 end) + 0.25 * least(1.0, rank / max_rank), 6) score from p)"""


def scored(spark, d):
    p = packets(spark, d)
    return p.withColumn("score", F.round(S.nonconformity("ensemble", F.col("retrieval"), F.col("verified"), F.col("rank"), F.col("max_rank")), 6))


def _at(q: float) -> str:
    return f"list_sort(list(value))[least(floor(count(*) * {q})::bigint, count(*) - 1) + 1]"


@query("agg17_percentiles", f"select event_type, count(*) as n, round(avg(value), 4) as mean, min(value) as least, max(value) as most, {_at(.5)} as p50, {_at(.95)} as p95, {_at(.99)} as p99 from events where value is not null group by 1")
def agg17(spark, d):
    return S.order_stats(events(spark, d), ["event_type"], "value", _Q).withColumn("mean", F.round("mean", 4))


@query("agg18_histogram_summary", f"select user_id, count(*) as n, round(sum(value), 3) as total, round(avg(value), 3) as mean, {_at(.5)} as p50, {_at(.95)} as p95 from events where value is not null group by 1")
def agg18(spark, d):
    x = S.order_stats(events(spark, d), ["user_id"], "value", {"p50": 0.5, "p95": 0.95})
    return x.select("user_id", "n", F.round(F.col("mean") * F.col("n"), 3).alias("total"), F.round("mean", 3).alias("mean"), "p50", "p95")


@query("agg19_aggregate_stats", "select event_type, count(*) as n, count(distinct user_id) as n_users, round(avg((value > 50)::int), 6) as hit_rate from events group by 1")
def agg19(spark, d):
    return events(spark, d).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("hit_rate"))


@query("agg20_latency", f"select count(*) as n, round(avg(value), 4) as mean, {_at(.99)} as p99 from events where value is not null")
def agg20(spark, d):
    x = S.order_stats(events(spark, d).withColumn("k", F.lit(1)), ["k"], "value", {"p99": 0.99})
    return x.select("n", F.round("mean", 4).alias("mean"), "p99")


_EDGES = [5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]


@query("snk15_histogram_buckets", "select event_type, le, count_if(value <= le) as n from events, (select unnest([5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]::double[] || ['inf'::double]) le) group by 1, 2")
def snk15(spark, d):
    return S.histogram(events(spark, d), ["event_type"], "value", _EDGES)


_KTH = """select "domain", count(*) as n, case when count(*) < 10 then 0.0 else list_sort(list(score))[greatest(least(ceil((count(*) + 1) * (1.0 - (1.0 - 0.9)))::bigint, count(*)), 1)] end as threshold from s group by 1"""


@query("agg22_conformal_by_domain", f"with {PACKETS} {_KTH}")
def agg22(spark, d):
    return S.conformal_threshold(scored(spark, d), ["domain"], "score")


@query("agg21_conformal_by_question", f"with {PACKETS} {_KTH.replace(chr(34) + 'domain' + chr(34), 'rank', 1)}")
def agg21(spark, d):
    return S.conformal_threshold(scored(spark, d), ["rank"], "score")


@query("agg23_coverage", f"with {PACKETS}, t as ({_KTH}) select s.\"domain\", round(avg((score <= threshold)::int), 9) as coverage from s join t using (\"domain\") group by 1")
def agg23(spark, d):
    s = scored(spark, d)
    c = S.coverage(s, S.conformal_threshold(s, ["domain"], "score"), ["domain"], "score")
    return c.withColumn("coverage", F.round("coverage", 9))


@query("flt18_predict", f"with {PACKETS}, t as ({_KTH}) select q, rank, s.\"domain\" from s join t using (\"domain\") where score <= threshold")
def flt18(spark, d):
    s = scored(spark, d)
    t = S.conformal_threshold(s, ["domain"], "score").select("domain", "threshold")
    return s.join(t, "domain").filter("score <= threshold").select("q", "rank", "domain")


@query("flt19_wrap", f"""with {PACKETS}, t as (select q, case when count(*) < 3 then 0.0 else list_sort(list(score))[1] end threshold from s group by 1), k as (select s.*, threshold, score <= threshold ok, count_if(score <= threshold) over (partition by s.q) n_ok from s join t using (q))
select q, rank from k where ok or (threshold = 0 and n_ok = 0)""")
def flt19(spark, d):
    """Packets within the threshold; where it is 0 for want of calibration and nothing passes, all of them."""
    s = scored(spark, d)
    t = s.groupBy("q").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("m")).select("q", F.when(F.col("c") < 3, 0.0).otherwise(F.col("m")).alias("threshold"))
    k = s.join(t, "q").withColumn("ok", F.col("score") <= F.col("threshold"))
    k = k.withColumn("n_ok", F.count_if("ok").over(Window.partitionBy("q")))
    return k.filter("ok or (threshold = 0 and n_ok = 0)").select("q", "rank")


@query("fn09_nonconformity", f"with {PACKETS} select q, rank, score from s")
def fn09(spark, d):
    return scored(spark, d).select("q", "rank", "score")


@query("win12_rank_scores", f"with {PACKETS} select q, rank, round(least(1.0, rank / max_rank), 9) as score from p")
def win12(spark, d):
    p = packets(spark, d)
    return p.select("q", "rank", F.round(S.nonconformity("rank_based", F.col("retrieval"), F.col("verified"), F.col("rank"), F.col("max_rank")), 9).alias("score"))


@query("fn07_confidence", f"with {PACKETS} select q, rank, round(greatest(0.0, least(1.0, 0.6 * verified::int + 0.4 * retrieval - 0.05 * rank)), 9) as confidence from p")
def fn07(spark, d):
    raw = 0.6 * F.col("verified").cast("int") + 0.4 * F.col("retrieval") - 0.05 * F.col("rank")
    return packets(spark, d).select("q", "rank", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 9).alias("confidence"))


@query("fn08_hierarchical_confidence", f"with {PACKETS} select q, rank, round(retrieval * (1 - rank / 10.0) * 0.9, 9) as confidence from p")
def fn08(spark, d):
    c = S.hierarchical_confidence(F.col("retrieval"), 1 - F.col("rank") / 10.0, F.lit(0.9))
    return packets(spark, d).select("q", "rank", F.round(c, 9).alias("confidence"))


@query("agg24_trends", """with e as (select user_id, ts, value from events where value is not null), s as (select user_id, count(*) n, min_by(value, (ts, value)) f, max_by(value, (ts, value)) l, avg(value) m, stddev_pop(value) d from e group by 1),
o as (select e.user_id, count(*) c from e join s using (user_id) where d > 0 and abs(value - m) > 1.5 * d group by 1)
select user_id, n as n_points, f as first_value, l as last_value, round(l - f, 6) as diff, case when l > f then 'increase' when l < f then 'decrease' else 'no change' end as direction, coalesce(c, 0) as n_outliers from s left join o using (user_id)""")
def agg24(spark, d):
    x = T.trend(events(spark, d).filter("value is not null"), "user_id", "ts", "value")
    return x.select("user_id", "n_points", "first_value", "last_value", F.round("diff", 6).alias("diff"), "direction", "n_outliers")


@query("agg24_moving_average", "select event_id, round(avg(value) over (partition by user_id order by ts, value, event_id rows between 2 preceding and current row), 6) as moving from events")
def agg24b(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "value", "event_id").rowsBetween(-2, 0)
    return events(spark, d).select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query("agg09_metrics_at", "select user_id, event_type, max_by(value, (ts, event_id)) as value from events where ts <= timestamp '2024-01-15' and value is not null group by 1, 2")
def agg09(spark, d):
    """Metrics of an entity at an instant, folded from its change log: the last value of each field."""
    e = events(spark, d).filter((F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")) & F.col("value").isNotNull())
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("fn06_compare_metrics", """with v as (select event_id, value a, lag(value) over (partition by user_id, event_type order by ts, event_id) b from events)
select event_id, round(a - b, 6) as diff, round(case when b = 0 then 0.0 else (a - b) / b * 100 end, 4) as percent, case when a - b > 0 then 'increase' when a - b < 0 then 'decrease' else 'no change' end as direction from v where b is not null and a is not null""")
def fn06(spark, d):
    v = events(spark, d).withColumn("old", F.lag("value").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    diff, percent, direction = T.compare(F.col("old"), F.col("value"))
    v = v.filter("old is not null and value is not null")
    return v.select("event_id", F.round(diff, 6).alias("diff"), F.round(percent, 4).alias("percent"), direction.alias("direction"))


@query("srt14_timeline", "select event_id, row_number() over (partition by user_id order by ts, event_id) as position from events")
def srt14(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, d).select("event_id", F.row_number().over(w).cast("long").alias("position"))


@query("srt13_snapshot_as_of", "select user_id, max_by(event_id, (ts, event_id)) as event_id from events where ts <= timestamp '2024-01-20' group by 1")
def srt13(spark, d):
    e = events(spark, d).filter(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("flt22_recent_hits", "select event_type, event_id, position from (select *, row_number() over (partition by event_type order by ts desc, event_id) position from events where value >= 50) where position <= 10")
def flt22(spark, d):
    """The ten newest of each kind with a least value; the limit is the report's."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    e = events(spark, d).filter("value >= 50").withColumn("position", F.row_number().over(w).cast("long"))
    return e.filter("position <= 10").select("event_type", "event_id", "position")


@query("str09_transitions", "select event_id, lag(event_type) over w as from_state, event_type as to_state, epoch_us(ts) - lag(epoch_us(ts)) over w as took_us from events window w as (partition by user_id order by ts, event_id)")
def str09(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = micros("ts")
    return events(spark, d).select("event_id", F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state"), (us - F.lag(us).over(w)).alias("took_us"))


@query("str10_trace_graph", "with t as (select lag(event_type) over (partition by user_id order by ts, event_id) a, event_type b from events) select a as from_state, b as to_state, count(*) as n from t where a is not null group by 1, 2")
def str10(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = events(spark, d).select(F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state"))
    return t.filter("from_state is not null").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


@query("snk12_query_cache", "select event_type as query_hash, user_id as doc_id, count(*) as hit_count, max_by(event_id, (ts, event_id)) as last_event from events group by 1, 2")
def snk12(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("query_hash"), F.col("user_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("hit_count"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("snk13_prune_cache", "select event_id from events where ts >= timestamp '2024-01-23'")
def snk13(spark, d):
    return events(spark, d).filter(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")).select("event_id")


@query("joi15_resolve_conflicts", f"""with {PACKETS}, w as (select q, "domain", max_by(rank, (retrieval, -rank)) keep, count(*) c from p group by 1, 2) select distinct p.q, p.rank from p join w using (q, "domain") where p.rank = w.keep""")
def joi15(spark, d):
    """Of packets of one question and domain that contradict each other the most confident stays (tie: the first)."""
    p = packets(spark, d)
    best = p.groupBy("q", "domain").agg(F.max_by("rank", F.struct("retrieval", -F.col("rank"))).alias("rank"))
    return best.select("q", "rank").distinct()


@query("qry08_calibrate", f"with {PACKETS}, g as (select q, coalesce(min(score) filter (where verified), 1.0) score, 'all' k from s group by 1) select k, count(*) as n, list_sort(list(score))[greatest(least(ceil((count(*) + 1) * (1.0 - (1.0 - 0.9)))::bigint, count(*)), 1)] as threshold from g group by 1")
def qry08(spark, d):
    """Per example the least score of the packets that hold the answer, else 1, and the threshold of these."""
    g = scored(spark, d).groupBy("q").agg(F.coalesce(F.min(F.when(F.col("verified"), F.col("score"))), F.lit(1.0)).alias("score"))
    return S.conformal_threshold(g.withColumn("k", F.lit("all")), ["k"], "score")


@query("agg25_audit", f"with {PACKETS}, f as (select *, exp(-0.05 * rank) * retrieval fresh from p) select q, round(avg(fresh), 9) as mean_freshness, count_if(fresh < 0.6) as n_stale, count(distinct verified) > 1 as conflict from f group by 1")
def agg25(spark, d):
    f = packets(spark, d).withColumn("fresh", F.exp(-0.05 * F.col("rank")) * F.col("retrieval"))
    return f.groupBy("q").agg(F.round(F.avg("fresh"), 9).alias("mean_freshness"), F.count_if(F.col("fresh") < 0.6).alias("n_stale"), (F.countDistinct("verified") > 1).alias("conflict"))


@query("agg26_temporal_accuracy", f"with {PACKETS} select q, (min_by(retrieval, (rank, retrieval)) = max(retrieval))::int::double as accuracy from p group by 1")
def agg26(spark, d):
    hit = F.min_by("retrieval", F.struct("rank", "retrieval")) == F.max("retrieval")
    return packets(spark, d).groupBy("q").agg(hit.cast("double").alias("accuracy"))


@query("fn27_token_f1", r"""with x as (select doc_id, [w for w in regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(coalesce(lang, '')), '[^a-z0-9_\s]', '', 'g'), '\b(a|an|the)\b', ' ', 'g')), '\s+') if w <> ''] p,
[w for w in regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(replace(coalesce(source, ''), '_', ' en ')), '[^a-z0-9_\s]', '', 'g'), '\b(a|an|the)\b', ' ', 'g')), '\s+') if w <> ''] t from documents),
c as (select doc_id, p, t, list_sum([least(len([y for y in p if y = z]), len([y for y in t if y = z])) for z in list_distinct(p)])::bigint s from x)
select doc_id, round(case when s > 0 then 2.0 * s / (len(p) + len(t)) else 0.0 end, 9) as f1 from c""")
def fn27(spark, d):
    f1 = S.token_f1(F.coalesce("lang", F.lit("")), F.replace(F.coalesce("source", F.lit("")), F.lit("_"), F.lit(" en ")))
    return table(spark, d, "documents").select("doc_id", F.round(f1, 9).alias("f1"))
