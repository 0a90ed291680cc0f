"""Queries over facts derived from orders: a customer is a document, a priority a subject, the status its value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.operators import facts as O
from strataleaf.operators.hierarchy import descendants, hierarchy
from strataleaf.plans.base import Registry
from strataleaf.sources.tables import table

query = Registry()
T0, T1, NOW = "1997-01-01", "1998-01-01", "1999-06-01"


def facts(spark: SparkSession, d: str, days: int | None = None) -> DataFrame:
    """``days``: a fact holds so long; else until the subject's next fact."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    until = F.lead("o_orderdate").over(w) if days is None else F.col("o_orderdate") + F.make_dt_interval(F.lit(days))
    key = F.col("o_orderkey").cast("string")
    return o.select(
        key.alias("fact_id"), F.col("c_mktsegment").alias("tenant_id"), F.col("o_custkey").cast("string").alias("doc_id"),
        F.col("o_orderpriority").alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"),
        (F.col("o_orderkey") % 101 / 100.0).alias("confidence"), F.col("o_orderdate").alias("valid_from"), until.alias("valid_to"),
        F.col("o_orderdate").alias("created_at"), F.lag(key).over(w).alias("parent_fact_id"), F.lead(key).over(w).alias("superseded_by"),
        F.row_number().over(w).alias("version_number"), F.lit("regex").alias("extraction_method"),
    )


def _with(days: int | None) -> str:
    until = f"o_orderdate + interval {days} day" if days else "lead(o_orderdate) over w"
    return f"""facts as (select cast(o_orderkey as varchar) fact_id, c_mktsegment tenant_id, cast(o_custkey as varchar) doc_id,
o_orderpriority subject, 'status' predicate, o_orderstatus object, o_orderkey % 101 / 100.0 confidence, o_orderdate valid_from,
{until} valid_to, o_orderdate created_at, lag(cast(o_orderkey as varchar)) over w parent_fact_id,
lead(cast(o_orderkey as varchar)) over w superseded_by, row_number() over w version_number, 'regex' extraction_method
from orders join customer on c_custkey = o_custkey window w as (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey))"""


LEAD, D90 = f"with {_with(None)}\n", f"with {_with(90)}\n"
_AT = "valid_from <= timestamp '{0}' and (valid_to is null or valid_to > timestamp '{0}')"
_COLS = "tenant_id, doc_id, subject, fact_id, object, epoch_us(valid_from) as from_us"


def _out(df: DataFrame) -> DataFrame:
    return df.select("tenant_id", "doc_id", "subject", "fact_id", "object", micros("valid_from").alias("from_us"))


@query("flt05_newest_facts", f"{LEAD} select tenant_id, fact_id, position from (select *, row_number() over (partition by tenant_id order by created_at desc, fact_id) position from facts) where position <= 100")
def flt05(spark, d):
    return O.page(facts(spark, d), ("tenant_id",), 100).select("tenant_id", "fact_id", "position")


@query("flt06_facts_by_document", f"{LEAD} select tenant_id, doc_id, fact_id, position from (select *, row_number() over (partition by tenant_id, doc_id order by created_at, fact_id) position from facts) where position <= 500")
def flt06(spark, d):
    return O.page(facts(spark, d), O.DOC, 500, newest=False).select("tenant_id", "doc_id", "fact_id", "position")


@query("flt07_facts_at_time", f"{LEAD} select {_COLS} from facts where {_AT.format(T1)}")
def flt07(spark, d):
    return _out(facts(spark, d).filter(O.valid_at(T1)))


@query("flt08_facts_between", f"{LEAD} select {_COLS} from facts where valid_from <= timestamp '{T1}' and (valid_to is null or valid_to > timestamp '{T0}')")
def flt08(spark, d):
    return _out(facts(spark, d).filter(O.valid_between(T0, T1)))


@query("flt09_facts_before", f"{LEAD} select {_COLS} from facts where valid_to <= timestamp '{T1}'")
def flt09(spark, d):
    return _out(facts(spark, d).filter(F.col("valid_to") <= O.instant(T1)))


@query("flt10_facts_after", f"{LEAD} select {_COLS} from facts where valid_from >= timestamp '{T1}'")
def flt10(spark, d):
    return _out(facts(spark, d).filter(F.col("valid_from") >= O.instant(T1)))


@query("flt11_facts_latest_first", f"{LEAD} select tenant_id, doc_id, fact_id, row_number() over (partition by tenant_id, doc_id order by created_at desc, fact_id) as position from facts")
def flt11(spark, d):
    return O.page(facts(spark, d), O.DOC, 1 << 62).select("tenant_id", "doc_id", "fact_id", "position")


@query("flt12_facts_current", f"{D90} select {_COLS} from facts where {_AT.format(NOW)}")
def flt12(spark, d):
    return _out(facts(spark, d, 90).filter(O.valid_at(NOW)))


@query("agg05_subjects", f"{LEAD} select distinct tenant_id, doc_id, subject from facts where {_AT.format(T1)}")
def agg05(spark, d):
    return facts(spark, d).filter(O.valid_at(T1)).select(*O.SUBJECT).distinct()


@query("agg06_snapshot", f"{D90} select tenant_id, doc_id, subject, string_agg(fact_id, ',' order by created_at desc, fact_id desc) as fact_ids from facts where {_AT.format(T1)} group by 1, 2, 3")
def agg06(spark, d):
    return O.snapshot(facts(spark, d, 90), T1).withColumn("fact_ids", F.array_join("fact_ids", ","))


_STATE = "select * from (select *, row_number() over (partition by tenant_id, doc_id, subject order by created_at desc, fact_id) r, count(*) over (partition by tenant_id, doc_id, subject) version_count from facts where {0}) where r = 1"


@query("agg07_state_at", f"{D90} select {_COLS} from ({_STATE.format(_AT.format(T1))})")
def agg07(spark, d):
    return _out(O.state_at(facts(spark, d, 90), T1))


@query("agg08_state_with_counts", f"{D90} select tenant_id, doc_id, subject, fact_id, version_count from ({_STATE.format(_AT.format(T1))})")
def agg08(spark, d):
    return O.state_at(facts(spark, d, 90), T1).select(*O.SUBJECT, "fact_id", "version_count")


_DELTA = """select coalesce(x.tenant_id, y.tenant_id) tenant_id, coalesce(x.doc_id, y.doc_id) doc_id, coalesce(x.fact_id, y.fact_id) fact_id,
case when x.fact_id is null then 'added' else 'removed' end as change from (select * from facts where {0}) x
full join (select * from facts where {1}) y on x.tenant_id = y.tenant_id and x.doc_id = y.doc_id and x.fact_id = y.fact_id
where x.fact_id is null or y.fact_id is null"""


@query("joi20_delta", f"{LEAD} {_DELTA.format(_AT.format(T0), _AT.format(T1))}")
def joi20(spark, d):
    return O.delta(facts(spark, d), T0, T1)


@query("set03_compare_states", f"""{D90}, a as ({_STATE.format(_AT.format(T0))}), b as ({_STATE.format(_AT.format(T1))})
select coalesce(a.tenant_id, b.tenant_id) tenant_id, coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.subject, b.subject) subject, a.object as before, b.object as after,
case when a.fact_id is null then 'added' when b.fact_id is null then 'removed' when a.object <> b.object then 'changed' else 'same' end as change
from a full join b on a.tenant_id = b.tenant_id and a.doc_id = b.doc_id and a.subject = b.subject""")
def set03(spark, d):
    return O.compare_states(facts(spark, d, 90), T0, T1)


STEPS = ["1997-01-01", "1997-04-01", "1997-07-01", "1997-10-01", "1998-01-01"]


@query("win10_delta_range", f"{D90} " + " union all ".join(
    f"select tenant_id, doc_id, fact_id, {k} as step, case when {_AT.format(b)} then 'added' else 'removed' end as change from facts where ({_AT.format(a)}) <> ({_AT.format(b)})"
    for k, (a, b) in enumerate(zip(STEPS, STEPS[1:]), 1)))
def win10(spark, d):
    return O.delta_range(facts(spark, d, 90), STEPS)


@query("set01_merge_deltas", f"""{D90}, d as (""" + " union all ".join(
    f"select tenant_id, doc_id, fact_id, {k} as step, case when {_AT.format(b)} then 'added' else 'removed' end as change from facts where ({_AT.format(a)}) <> ({_AT.format(b)})"
    for k, (a, b) in enumerate(zip(STEPS, STEPS[1:]), 1)) + """) select tenant_id, doc_id, fact_id, max_by(change, step) as change from d
group by 1, 2, 3 having bool_or(change = 'added') <> bool_or(change = 'removed')""")  # fmt: skip
def set01(spark, d):
    """Neighbouring deltas merged: what was added and later removed cancels out."""
    x = O.delta_range(facts(spark, d, 90), STEPS).groupBy("tenant_id", "doc_id", "fact_id")
    x = x.agg(F.max_by("change", "step").alias("change"), F.bool_or(F.col("change") == "added").alias("a"), F.bool_or(F.col("change") == "removed").alias("r"))
    return x.filter("a <> r").drop("a", "r")


_PAIR = """from facts a join facts b on a.tenant_id = b.tenant_id and a.doc_id = b.doc_id and a.subject = b.subject"""
_CONFLICT = f"""select a.tenant_id, a.doc_id, a.subject, a.fact_id a_fact_id, b.fact_id b_fact_id, case when a.object = b.object then 'WINDOW_OVERLAP' else 'VALUE_CONFLICT' end as kind
{_PAIR} where (a.created_at, a.fact_id) < (b.created_at, b.fact_id) and a.valid_from <= coalesce(b.valid_to, timestamp '9999-12-31') and coalesce(a.valid_to, timestamp '9999-12-31') > b.valid_from"""


@query("joi06_conflicts", f"{D90} {_CONFLICT}")
def joi06(spark, d):
    return O.conflicts(facts(spark, d, 90))


@query("joi08_conflict_report", f"{D90} select tenant_id, doc_id, kind, count(*) as n_pairs from ({_CONFLICT}) group by 1, 2, 3")
def joi08(spark, d):
    return O.conflicts(facts(spark, d, 90)).groupBy(*O.DOC, "kind").agg(F.count(F.lit(1)).alias("n_pairs"))


_CHAIN = f"""select a.tenant_id, a.doc_id, a.subject, a.fact_id a_fact_id, b.fact_id b_fact_id {_PAIR}
where (a.valid_from, a.fact_id) < (b.valid_from, b.fact_id) and (a.valid_to is null or a.valid_to > b.valid_from)
and not coalesce(a.superseded_by = b.fact_id, false) and not coalesce(b.superseded_by = a.fact_id, false)
and not coalesce(a.parent_fact_id = b.fact_id, false) and not coalesce(b.parent_fact_id = a.fact_id, false)"""


@query("joi09_chain_overlaps", f"{D90} {_CHAIN}")
def joi09(spark, d):
    return O.chain_overlaps(facts(spark, d, 90))


def _flawed(df: DataFrame) -> DataFrame:
    """All facts; of some the superseding or the preceding fact isn't there, or the version number jumps, so that the
    checks have something to find."""
    n = F.col("fact_id").cast("long")
    lost = lambda c, k: F.when(n % k == 0, F.concat(F.lit("lost-"), c)).otherwise(F.col(c))
    links = {"superseded_by": lost("superseded_by", 7), "parent_fact_id": lost("parent_fact_id", 11)}
    return df.withColumns(links | {"version_number": F.col("version_number") + F.when(n % 13 == 0, 1000).otherwise(0)})


_FLAWED = """facts as (select * replace (case when fact_id::bigint % 7 = 0 then 'lost-' || superseded_by else superseded_by end as superseded_by,
case when fact_id::bigint % 11 = 0 then 'lost-' || parent_fact_id else parent_fact_id end as parent_fact_id,
version_number + case when fact_id::bigint % 13 = 0 then 1000 else 0 end as version_number) from f0)"""
FLAWED90 = D90.replace("facts as (", "f0 as (", 1).rstrip() + f", {_FLAWED}\n"


@query("joi10_broken_links", f"""{FLAWED90} select tenant_id, fact_id, link, target from (select tenant_id, fact_id, 'parent_fact_id' link, parent_fact_id target from facts
union all select tenant_id, fact_id, 'superseded_by', superseded_by from facts) l where target is not null and not exists (select 1 from facts f where f.tenant_id = l.tenant_id and f.fact_id = l.target)""")
def joi10(spark, d):
    return O.broken_links(_flawed(facts(spark, d, 90)))


@query("joi11_unexpected_superseders", """with f as (select cast(o_orderkey as varchar) fact_id, 'all' tenant_id, o_orderpriority subject,
lead(cast(o_orderkey as varchar)) over (partition by o_custkey order by o_orderdate, o_orderkey) superseded_by from orders)
select a.tenant_id, a.fact_id, a.superseded_by, a.subject, b.subject other_subject from f a join f b on a.superseded_by = b.fact_id where a.subject <> b.subject""")
def joi11(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = F.col("o_orderkey").cast("string")
    f = table(spark, d, "orders").select(key.alias("fact_id"), F.lit("all").alias("tenant_id"), F.col("o_orderpriority").alias("subject"), F.lead(key).over(w).alias("superseded_by"))
    return O.unexpected_superseders(f)


@query("joi12_chain_orphans", """with f as (select cast(o_orderkey as varchar) fact_id, 'all' tenant_id, cast(o_custkey as varchar) doc_id, o_orderpriority subject,
lag(cast(o_orderkey as varchar)) over (partition by o_custkey, o_orderpriority, o_orderstatus order by o_orderdate, o_orderkey) parent,
lead(cast(o_orderkey as varchar)) over (partition by o_custkey, o_orderpriority, o_orderstatus order by o_orderdate, o_orderkey) sup from orders),
c as (select *, count(*) over (partition by doc_id, subject) chain from f)
select tenant_id, doc_id, subject, fact_id, chain from c where parent is null and sup is null and chain > 1""")
def joi12(spark, d):
    w = Window.partitionBy("o_custkey", "o_orderpriority", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    key = F.col("o_orderkey").cast("string")
    f = table(spark, d, "orders").select(
        key.alias("fact_id"), F.lit("all").alias("tenant_id"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("subject"),
        F.lag(key).over(w).alias("parent_fact_id"), F.lead(key).over(w).alias("superseded_by"),
    )
    return O.chain_orphans(f)


@query("joi13_related_facts", f"{LEAD} select tenant_id, subject, count(*) as n_facts, count(distinct doc_id) as n_docs from facts where length(subject) >= 4 group by 1, 2")
def joi13(spark, d):
    return O.related_facts(facts(spark, d))


def _forked(spark: SparkSession, d: str) -> DataFrame:
    """The parent is the subject's first fact, so it has all others as children."""
    w = Window.partitionBy("tenant_id", "doc_id", "subject").orderBy("created_at", "fact_id")
    f = facts(spark, d).withColumn("first", F.first("fact_id").over(w))
    return f.withColumn("parent_fact_id", F.when(F.col("first") != F.col("fact_id"), F.col("first"))).drop("first")


_FORK = f"""{LEAD.rstrip()}, g as (select *, first(fact_id) over (partition by tenant_id, doc_id, subject order by created_at, fact_id) f1 from facts)
select tenant_id, f1 as parent_fact_id, string_agg(fact_id, ',' order by created_at, fact_id) as children from g where f1 <> fact_id group by tenant_id, f1 having count(*) > 1"""


@query("agg11_forks", _FORK)
def agg11(spark, d):
    return O.forks(_forked(spark, d)).withColumn("children", F.array_join("children", ","))


@query("grf14_fork_branches", f"select tenant_id, parent_fact_id, unnest(string_split(children, ',')) as child, generate_subscripts(string_split(children, ','), 1) as branch from ({_FORK})")
def grf14(spark, d):
    f = O.forks(_forked(spark, d))
    return f.select("tenant_id", "parent_fact_id", F.posexplode("children").alias("branch", "child")).withColumn("branch", (F.col("branch") + 1).cast("long"))


@query("win06_version_gaps", f"""{FLAWED90} select tenant_id, doc_id, subject, fact_id, version_number as found, expected from
(select *, coalesce(lag(version_number) over (partition by tenant_id, doc_id, subject order by created_at, fact_id) + 1, 1) expected from facts) where version_number <> expected""")
def win06(spark, d):
    return O.version_gaps(_flawed(facts(spark, d, 90)))


@query("agg12_duplicate_versions", """select c_mktsegment tenant_id, cast(o_custkey as varchar) doc_id, o_orderpriority subject, year(o_orderdate) version_number, count(*) n_facts
from orders join customer on c_custkey = o_custkey group by all having count(*) > 1""")
def agg12(spark, d):
    return O.duplicate_versions(facts(spark, d).withColumn("version_number", F.year("valid_from").cast("long")))


@query("win07_expired_active", f"{D90} select {_COLS} from facts where valid_to < timestamp '{NOW}' and superseded_by is null")
def win07(spark, d):
    return _out(O.expired_active(facts(spark, d, 90), NOW))


def _dirty(df: DataFrame) -> DataFrame:
    return df.withColumn("object", F.when(F.col("object") != "P", F.col("object")).otherwise(F.lit(" "))).withColumn("confidence", F.col("confidence") * 1.2).withColumn(
        "extraction_method", F.when(F.col("subject").startswith("1"), "guess").otherwise(F.col("extraction_method")))


DIRTY = FLAWED90.rstrip() + """, q as (select * replace (case when object <> 'P' then object else ' ' end as object, confidence * 1.2 as confidence,
case when subject like '1%' then 'guess' else extraction_method end as extraction_method) from facts)
"""
_ISSUES = """select tenant_id, doc_id, fact_id, 'MISSING_REQUIRED_FIELDS:object' as check_type from q where trim(object) = ''
union all select tenant_id, doc_id, fact_id, 'CONFIDENCE_RANGE' from q where confidence not between 0 and 1
union all select tenant_id, doc_id, fact_id, 'EXTRACTION_METHOD' from q where extraction_method = 'guess'"""


@query("agg14_fact_issues", f"{DIRTY} select tenant_id, fact_id, check_type from ({_ISSUES})")
def agg14(spark, d):
    return O.fact_issues(_dirty(_flawed(facts(spark, d, 90))))


@query("agg13_document_issues", f"""{DIRTY} select tenant_id, doc_id, check_type, count(*) as n_issues from ({_ISSUES}
union all select tenant_id, doc_id, fact_id, 'SUPERSESSION_INTEGRITY' from (select *, unnest([parent_fact_id, superseded_by]) target from facts) l
where target is not null and not exists (select 1 from facts f where f.tenant_id = l.tenant_id and f.fact_id = l.target)
union all select tenant_id, doc_id, a_fact_id, 'VALIDITY_WINDOW_OVERLAP' from ({_CHAIN})) group by 1, 2, 3""")
def agg13(spark, d):
    return O.document_issues(_dirty(_flawed(facts(spark, d, 90))))


@query("agg15_chain_summary", f"""{FLAWED90.rstrip()}, gaps as (select tenant_id, doc_id, subject, count(*) n from (select *, coalesce(lag(version_number) over (partition by tenant_id, doc_id, subject
order by created_at, fact_id) + 1, 1) expected from facts) where version_number <> expected group by 1, 2, 3),
over_ as (select tenant_id, doc_id, subject, count(*) n from ({_CHAIN}) group by 1, 2, 3)
select f.tenant_id, f.doc_id, f.subject, count(*) as n_facts, coalesce(max(g.n), 0) as n_gaps, 0 as n_forks, coalesce(max(o.n), 0) as n_overlaps,
coalesce(max(g.n), 0) + coalesce(max(o.n), 0) = 0 as healthy from facts f left join gaps g using (tenant_id, doc_id, subject) left join over_ o using (tenant_id, doc_id, subject) group by 1, 2, 3""")
def agg15(spark, d):
    return O.chain_summary(_flawed(facts(spark, d, 90)))


@query("win11_fact_history", f"{LEAD} select tenant_id, doc_id, subject, fact_id, row_number() over (partition by tenant_id, doc_id, subject order by valid_from, fact_id) as position from facts")
def win11(spark, d):
    w = Window.partitionBy(*O.SUBJECT).orderBy("valid_from", "fact_id")
    return facts(spark, d).select(*O.SUBJECT, "fact_id", F.row_number().over(w).alias("position"))


@query("grf13_authoritative", f"{LEAD} select tenant_id, doc_id, subject, max_by(fact_id, (superseded_by is null, valid_from, created_at, fact_id)) as fact_id from facts group by 1, 2, 3")
def grf13(spark, d):
    return O.authoritative(facts(spark, d))


def _lineage(spark: SparkSession, d: str, link: str) -> DataFrame:
    f = facts(spark, d)
    return hierarchy(f.select(F.col("fact_id").alias("key"), F.col("fact_id").alias("name"), F.col(link).alias("parent")), with_paths=True)


_CHAINPOS = f"{LEAD} select fact_id, first(fact_id) over w as origin, row_number() over w - 1 as steps from facts window w as (partition by tenant_id, doc_id, subject order by valid_from, try_cast(fact_id as bigint))"


@query("grf09_origin", _CHAINPOS)
def grf09(spark, d):
    return _lineage(spark, d, "parent_fact_id").select(F.col("node_id").alias("fact_id"), F.col("root_id").alias("origin"), F.col("level_no").alias("steps"))


_DESC = f"""{LEAD.rstrip()}, n as (select *, row_number() over (partition by tenant_id, doc_id, subject order by valid_from, try_cast(fact_id as bigint)) k from facts)
select a.fact_id, b.fact_id as descendant, b.k - a.k as steps from n a join n b using (tenant_id, doc_id, subject) where b.k > a.k"""


@query("grf10_descendants", _DESC)
def grf10(spark, d):
    x = descendants(_lineage(spark, d, "parent_fact_id"))
    return x.select(F.col("ancestor_id").alias("fact_id"), F.col("node_id").alias("descendant"), F.col("distance").alias("steps"))


@query("grf12_superseded_chain", _DESC.replace("a.fact_id, b.fact_id as descendant", "a.fact_id, b.fact_id as superseder"))
def grf12(spark, d):
    x = descendants(_lineage(spark, d, "superseded_by"))
    return x.select(F.col("node_id").alias("fact_id"), F.col("ancestor_id").alias("superseder"), F.col("distance").alias("steps"))


@query("snk08_tombstones", f"""{LEAD} select '__DELETED__' || substr(sha256(fact_id), 1, 16) as fact_id, tenant_id, doc_id, fact_id as parent_fact_id from facts where confidence = 0""")
def snk08(spark, d):
    f = facts(spark, d)
    return O.tombstone(f, f.filter("confidence = 0").select("tenant_id", "fact_id"), NOW).select("fact_id", "tenant_id", "doc_id", "parent_fact_id")


@query("str05_snapshot_between", f"""{D90}, base as (select * from facts where {_AT.format(T0)}), ch as ({_DELTA.format(_AT.format(T0), _AT.format(T1))})
select tenant_id, doc_id, fact_id from base where fact_id not in (select fact_id from ch where change = 'removed') union all select tenant_id, doc_id, fact_id from ch where change = 'added'""")
def str05(spark, d):
    """A snapshot from an earlier one and a delta, without reading the facts between."""
    f = facts(spark, d, 90)
    base, change = f.filter(O.valid_at(T0)).select(*O.DOC, "fact_id"), O.delta(f, T0, T1)
    kept = base.join(change.filter("change = 'removed'"), [*O.DOC, "fact_id"], "left_anti")
    return kept.unionByName(change.filter("change = 'added'").drop("change"))
