"""Jobs as a table: picking, outcomes with retries and dead letters, clean-up, intake of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days that a finished job is kept and a queued file lives; characters of an error that are kept; attempts.
KEEP_DAYS, FILE_DAYS, ERROR_CHARS, MAX_RETRIES = 7, 7, 500, 3
OPEN = ("PENDING", "FAILED")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """``jobs`` with those of ``new`` (doc_id, tenant_id, content_hash, created_at) whose dedup_key no job has yet; of several with
    one key the first created stays. The key is made from document and content, so a repeated intake adds nothing."""
    key = F.sha2(F.concat_ws("|", "doc_id", "content_hash"), 256)
    first = new.withColumn("dedup_key", key).groupBy("dedup_key").agg(F.min(F.struct("created_at", "doc_id", "tenant_id")).alias("j"))
    first = first.join(jobs.select("dedup_key"), "dedup_key", "left_anti")
    added = first.select(
        F.col("dedup_key").alias("job_id"), "dedup_key", "j.doc_id", "j.tenant_id", F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"),
        F.lit(MAX_RETRIES).alias("max_retries"), F.lit(None).cast("string").alias("error_message"), F.lit(0).cast("long").alias("facts_extracted"),
        "j.created_at", F.lit(None).cast("timestamp_ntz").alias("completed_at"),
    )
    return jobs.unionByName(added)


def pending(jobs: DataFrame, limit: int | None = None, tenant: str | None = None) -> DataFrame:
    """Jobs that may run, pending or failed with attempts left, oldest first (tie: job_id); ``limit`` is the batch that a
    worker takes."""
    rows = jobs.filter(F.col("status").isin(*OPEN) & (F.col("retry_count") < F.col("max_retries")))
    rows = rows.filter(F.col("tenant_id") == tenant) if tenant else rows
    return rows if limit is None else rows.orderBy("created_at", "job_id").limit(limit)


def finished(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """``jobs`` after ``outcomes`` (job_id, n_facts, error): a null error completes the job, another counts an attempt and
    makes it FAILED, or DEAD_LETTER when none is left. Jobs without an outcome, or that may not run, stay as they are."""
    may = F.col("status").isin(*OPEN) & (F.col("retry_count") < F.col("max_retries"))
    o = outcomes.select("job_id", F.col("n_facts").alias("__n"), F.col("error").alias("__e"), F.lit(True).alias("__ran"))
    j = jobs.join(o, "job_id", "left").withColumn("__ran", F.coalesce("__ran", F.lit(False)) & may)
    ok, bad = F.col("__ran") & F.col("__e").isNull(), F.col("__ran") & F.col("__e").isNotNull()
    tries = F.col("retry_count") + F.when(bad, 1).otherwise(0)
    status = F.when(ok, "COMPLETED").when(bad & (tries >= F.col("max_retries")), "DEAD_LETTER").when(bad, "FAILED").otherwise(F.col("status"))
    changed = {
        "status": status, "retry_count": tries.cast("int"), "error_message": F.when(bad, F.substring("__e", 1, ERROR_CHARS)).otherwise(F.col("error_message")),
        "facts_extracted": F.when(ok, F.col("__n")).otherwise(F.col("facts_extracted")), "completed_at": F.when(ok, now).otherwise(F.col("completed_at")),
    }
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in jobs.columns])


def retried(jobs: DataFrame, tenant: str | None = None) -> DataFrame:
    """``jobs`` with dead letters pending again, without attempts and error."""
    dead = F.col("status") == "DEAD_LETTER"
    dead = dead & (F.col("tenant_id") == tenant) if tenant else dead
    return jobs.withColumns(
        {"status": F.when(dead, "PENDING").otherwise(F.col("status")), "retry_count": F.when(dead, 0).otherwise(F.col("retry_count")), "error_message": F.when(~dead, F.col("error_message"))}
    )


def cleaned(jobs: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """``jobs`` without those completed before midnight ``days`` days ago."""
    cutoff = F.date_trunc("day", now) - F.make_dt_interval(F.lit(days))
    return jobs.filter(~F.coalesce((F.col("status") == "COMPLETED") & (F.col("completed_at") < cutoff), F.lit(False)))


def queued_files(files: DataFrame) -> DataFrame:
    """(job_id, tenant_id, filename, content_hex, status, queued_at, expires_at) of (tenant_id, filename, content, queued_at);
    null contents are queued empty."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return files.select(
        F.sha2(F.concat_ws("|", "tenant_id", "filename"), 256).alias("job_id"), "tenant_id", "filename", F.lower(F.hex(content)).alias("content_hex"),
        F.lit("QUEUED").alias("status"), "queued_at", (F.col("queued_at") + F.make_dt_interval(F.lit(FILE_DAYS))).alias("expires_at"),
    )


def next_jobs(queue: DataFrame, now: Column) -> DataFrame:
    """The job that each tenant's worker pops: the first queued (tie: job_id) that hasn't expired."""
    alive = queue.filter((F.col("status") == "QUEUED") & (F.col("expires_at") > now))
    return alive.groupBy("tenant_id").agg(F.min(F.struct("queued_at", "job_id")).alias("j")).select("tenant_id", "j.job_id", "j.queued_at")
