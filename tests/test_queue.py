"""Transitions of jobs, step by step."""

from datetime import datetime

from pyspark.sql import functions as F

from strataleaf.operators import queue as J

T = datetime(2024, 5, 2, 15, 0)
KIND = "job_id string, dedup_key string, doc_id string, tenant_id string, status string, retry_count int, max_retries int, error_message string, facts_extracted long, created_at timestamp_ntz, completed_at timestamp_ntz, `error` string"


def now():
    return F.lit("2024-05-02 15:00:00").cast("timestamp_ntz")


def test_intake_and_outcomes(spark):
    none = spark.createDataFrame([], KIND).drop("error")
    new = spark.createDataFrame([("d1", "t", "h", T), ("d1", "t", "h", T), ("d2", "t", None, T), ("d2", "u", "h2", T)], "doc_id string, tenant_id string, content_hash string, created_at timestamp_ntz")
    jobs = J.enqueue(none, new)
    assert jobs.count() == 3 and J.enqueue(jobs, new).count() == 3
    assert J.pending(jobs, 1).count() == 1 and J.pending(jobs, tenant="u").count() == 1
    bad = jobs.filter("doc_id = 'd1'").select("job_id", F.lit(9).cast("long").alias("n_facts"), F.lit("x" * 600).alias("error"))
    seen = []
    for _ in range(4):
        jobs = J.finished(jobs, J.pending(jobs).select("job_id").join(bad, "job_id"), now())
        seen.append(jobs.filter("doc_id = 'd1'").first())
    assert [(x.status, x.retry_count) for x in seen] == [("FAILED", 1), ("FAILED", 2), ("DEAD_LETTER", 3), ("DEAD_LETTER", 3)]
    assert len(seen[0].error_message) == 500
    again = J.retried(jobs).filter("doc_id = 'd1'").first()
    assert (again.status, again.retry_count, again.error_message) == ("PENDING", 0, None)
    assert J.retried(jobs, "other").filter("status = 'DEAD_LETTER'").count() == 1
    ok = J.finished(J.retried(jobs), bad.withColumn("error", F.lit(None).cast("string")), now()).filter("doc_id = 'd1'").first()
    assert (ok.status, ok.facts_extracted, ok.completed_at) == ("COMPLETED", 9, T)
    assert J.finished(ok and jobs, bad.limit(0), now()).count() == jobs.count()


def test_clean_up_and_files(spark):
    rows = [("a", "COMPLETED", datetime(2024, 4, 24, 23, 59)), ("b", "COMPLETED", datetime(2024, 4, 25)), ("c", "COMPLETED", None), ("d", "FAILED", datetime(2020, 1, 1)), ("e", None, None)]
    jobs = spark.createDataFrame(rows, "job_id string, status string, completed_at timestamp_ntz")
    assert sorted(x.job_id for x in J.cleaned(jobs, now()).collect()) == ["b", "c", "d", "e"]
    files = spark.createDataFrame([("t", "f1", "é", T), ("t", "f0", None, T), ("u", "old", "x", datetime(2024, 4, 1))], "tenant_id string, filename string, content string, queued_at timestamp_ntz")
    q = J.queued_files(files)
    assert {x.content_hex for x in q.collect()} == {"c3a9", "", "78"}
    assert [x.tenant_id for x in J.next_jobs(q, now()).collect()] == ["t"]
    assert J.next_jobs(q.limit(0), now()).count() == 0
