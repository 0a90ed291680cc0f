"""Streams run over what is there, against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataleaf.functions.ids import micros
from strataleaf.plans.base import Registry
from strataleaf.streaming import jobs as J

query = Registry()


@query("str01_deduplicated_intake", "select distinct user_id, event_type, date_trunc('day', ts)::date as day from events")
def str01(spark, d):
    """One job per key, however often it is enqueued."""
    e = J.read(spark, f"{d}/events.parquet").select("user_id", "event_type", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"))
    return J.run_available(J.deduplicated(e, ["user_id", "event_type", "day"], "ts", "400 days").drop("ts"), "dedup")


@query("str13_windowed_counts", "select epoch_us(time_bucket(interval 1 hour, ts)) as from_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def str10(spark, d):
    e = J.read(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    w = J.run_available(J.windowed(e, "ts", "1 hour", ["event_type"], "value"), "windows", "complete")
    return w.select(micros("window_from").alias("from_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str07_rate_limited", """with recursive g as (select event_id, user_id, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) n from events),
w as (select user_id, event_id, n, [us] seen, true allowed from g where n = 1 union all
select g.user_id, g.event_id, g.n, [x for x in w.seen if g.us - x < 21600000000] || case when len([x for x in w.seen if g.us - x < 21600000000]) < 3 then [g.us] else [] end, len([x for x in w.seen if g.us - x < 21600000000]) < 3 from w join g on g.user_id = w.user_id and g.n = w.n + 1)
select event_id as id, user_id as key, allowed from w""")
def str07(spark, d):
    """At most three events a user in six hours."""
    e = J.read(spark, f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), micros("ts").alias("us"))
    return J.run_available(J.rate_limited(e, 3, 6 * 3600.0), "limit")
