"""Queries over job queues: orders as extraction jobs, nodes as what they extract from, documents as files to take in."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataleaf.operators import extract as X
from strataleaf.operators import queue as J
from strataleaf.operators.hierarchy import latest_nodes
from strataleaf.plans.base import Registry
from strataleaf.session import materialise
from strataleaf.sources.tables import table

query = Registry()
NOW = "1998-08-02 12:30:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def jobs(spark, d):
    """An order as a job: open ones pending, partly shipped ones failed, others completed; some have used up attempts."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    tries = (F.col("o_orderkey") % 5).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(tries >= 3, "DEAD_LETTER").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("PENDING")
    return o.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderkey").cast("string").alias("dedup_key"), F.col("o_custkey").cast("string").alias("doc_id"),
        F.col("c_mktsegment").alias("tenant_id"), status.alias("status"), tries.alias("retry_count"), F.lit(3).alias("max_retries"),
        F.when(status == "FAILED", "late").alias("error_message"), F.lit(0).cast("long").alias("facts_extracted"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.when(status == "COMPLETED", F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(30))).alias("completed_at"),
    )


JOBS = """j as (select o_orderkey::varchar job_id, o_custkey::varchar doc_id, c_mktsegment tenant_id, (o_orderkey % 5)::int retry_count, o_orderdate created_at,
case when o_orderstatus = 'F' then 'COMPLETED' when o_orderkey % 5 >= 3 then 'DEAD_LETTER' when o_orderstatus = 'P' then 'FAILED' else 'PENDING' end status,
case when o_orderstatus = 'F' then o_orderdate + interval 30 day end completed_at from orders join customer on c_custkey = o_custkey)"""


@query("flt23_pending_jobs", f"with {JOBS} select job_id, tenant_id, retry_count from j where status in ('PENDING', 'FAILED') and retry_count < 3")
def flt23(spark, d):
    return J.pending(jobs(spark, d)).select("job_id", "tenant_id", "retry_count")


@query("flt23_next_batch", f"with {JOBS} select job_id from j where status in ('PENDING', 'FAILED') and retry_count < 3 and tenant_id = 'BUILDING' order by created_at, job_id limit 10")
def flt23_batch(spark, d):
    """What a worker takes at once: its batch size is the operator's limit."""
    return J.pending(jobs(spark, d), 10, "BUILDING").select("job_id")


@query("flt24_jobs_kept", f"with {JOBS} select job_id, status from j where not coalesce(status = 'COMPLETED' and completed_at < date_trunc('day', timestamp '{NOW}') - interval 7 day, false)")
def flt24(spark, d):
    return J.cleaned(jobs(spark, d), _now()).select("job_id", "status")


@query("str03_dead_letters_again", f"with {JOBS} select job_id, case when status = 'DEAD_LETTER' then 'PENDING' else status end as status, case when status = 'DEAD_LETTER' then 0 else retry_count end as retry_count from j")
def str03(spark, d):
    return J.retried(jobs(spark, d)).select("job_id", "status", "retry_count")


@query("str02_processed_jobs", rf"""with n as (select * from (select *, row_number() over (partition by lower(trim(node_id, ' ')) order by ingestion_date desc, content desc, doc_id desc) r from apex_ast_nodes where trim(node_id, ' ') <> '') where r = 1),
x as (select doc_id, sum(len(regexp_extract_all(content, $r${X.PATTERNS['regulation'][0]}$r$)))::bigint n, count_if(trim(content, ' ') = '' or content is null) bad from n group by 1),
t as (select *, least(case when bad > 0 then 2 else 0 end, 2) tries from x)
select doc_id, case when bad = 0 then 'COMPLETED' else 'FAILED' end as status, tries::int as retry_count, case when bad = 0 then n else 0 end as facts_extracted, case when bad > 0 then bad || ' blank nodes' end as error_message from t""")
def str02(spark, d):
    """A job a document: its nodes' regulations are its facts, a blank node makes the attempt fail; two workers' turns."""
    n = latest_nodes(table(spark, d, "apex_ast_nodes"), "content", "doc_id")
    found = F.size(F.regexp_extract_all(F.col("content"), F.lit(f"(?Ud){X.PATTERNS['regulation'][0]}"), F.lit(0)))
    bad = F.count_if(F.coalesce(F.trim("content") == "", F.lit(True)))
    x = n.groupBy("doc_id").agg(F.sum(F.coalesce(found, F.lit(0))).cast("long").alias("n_facts"), bad.alias("bad"))
    new = x.select("doc_id", F.lit("t").alias("tenant_id"), F.lit("").alias("content_hash"), _now().alias("created_at"))
    outcomes = x.select("doc_id", "n_facts", F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" blank nodes"))).alias("error"))
    state = J.enqueue(jobs(spark, d).limit(0), new)
    for _ in range(2):
        state = materialise(state, "jobs")
        ran = J.pending(state).join(outcomes, "doc_id").select("job_id", "n_facts", "error")
        state = J.finished(state, ran, _now())
    return state.select("doc_id", "status", "retry_count", "facts_extracted", "error_message")


_FILES = """f as (select sha256(coalesce(lang, 'none') || '|' || doc_id::varchar || '.md') job_id, coalesce(lang, 'none') tenant_id, lower(hex(coalesce(text, ''))) content_hex, ingested_at queued_at from documents)"""


def files(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.coalesce("lang", F.lit("none")).alias("tenant_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), F.col("text").alias("content"), F.col("ingested_at").alias("queued_at"))


@query("snk16_queued_files", f"with {_FILES} select job_id, tenant_id, md5(content_hex) as digest, epoch_us(queued_at + interval 7 day) as expires_us from f")
def snk16(spark, d):
    q = J.queued_files(files(spark, d))
    return q.select("job_id", "tenant_id", F.md5("content_hex").alias("digest"), F.unix_micros(F.col("expires_at").cast("timestamp")).alias("expires_us"))


@query("snk17_next_jobs", f"with {_FILES} select tenant_id, job_id from (select *, row_number() over (partition by tenant_id order by queued_at, job_id) r from f where queued_at + interval 7 day > (select max(ingested_at) - interval 60 day from documents)) where r = 1")
def snk17(spark, d):
    """The first file of each tenant that is still queued at an instant."""
    q = J.queued_files(files(spark, d))
    at = table(spark, d, "documents").agg((F.max("ingested_at") - F.make_dt_interval(F.lit(60))).alias("at"))
    now = at.first()[0]
    return J.next_jobs(q, F.lit(now).cast("timestamp_ntz")).select("tenant_id", "job_id")
