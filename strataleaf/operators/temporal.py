"""Reads of versioned nodes, freshness, trends and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.operators.facts import instant, valid_at

# Daily decay rates by domain.
DECAY = {
    "general": 0.001, "news": 0.005, "market": 0.005, "financial": 0.005, "legal": 0.0002, "regulatory": 0.0002,
    "technical": 0.001, "scientific": 0.001, "medical": 0.0005, "educational": 0.001,
}


def top_version(versions: DataFrame, prefer_active: bool = False) -> DataFrame:
    """One row a node: the greatest version_number (tie: version_id); with ``prefer_active`` a current ACTIVE one
    goes first. The maximum is built map-side."""
    active = F.coalesce(F.col("is_current") & (F.col("validity_status") == "ACTIVE"), F.lit(False))
    order = F.struct(*([active] if prefer_active else []), "version_number", "version_id")
    return versions.groupBy("node_id").agg(F.max_by("version_id", order).alias("version_id"), F.count(F.lit(1)).alias("n_versions"))


def version_at(versions: DataFrame, t: str) -> DataFrame:
    """One row a node: of the versions whose window covers ``t`` the one with the greatest version_number."""
    return top_version(versions.filter(valid_at(t, "effective_from", "effective_to"))).drop("n_versions")


def status_of(now: str) -> Column:
    """Status as the stored window and flag tell it: EXPIRED, ACTIVE or SUPERSEDED."""
    return F.when(F.col("effective_to") < instant(now), "EXPIRED").when(F.col("is_current"), "ACTIVE").otherwise("SUPERSEDED")


def unexpired(nodes: DataFrame, metadata: DataFrame, t: str) -> DataFrame:
    """Nodes without metadata, or with some row of status ACTIVE or PENDING whose window covers ``t``."""
    good = F.col("validity_status").isin("ACTIVE", "PENDING") & valid_at(t, "effective_from", "effective_to")
    m = metadata.groupBy("node_id").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("ok"))
    return nodes.join(m, "node_id", "left").filter(F.coalesce("ok", F.lit(True))).drop("ok")


def freshness(source: Column | str, today: str, domain: Column | None = None, rate: float | None = None) -> Column:
    """exp(-rate·days), 1 for a null or future date; the rate by domain, unknown domains as ``general``."""
    days = F.date_diff(F.lit(today).cast("date"), (F.col(source) if isinstance(source, str) else source).cast("date"))
    if rate is not None:
        r: Column = F.lit(rate)
    elif domain is None:
        r = F.lit(DECAY["general"])
    else:
        r = F.coalesce(F.create_map(*[F.lit(x) for kv in DECAY.items() for x in kv])[domain], F.lit(DECAY["general"]))
    return F.when(days > 0, F.exp(-r * days)).otherwise(F.lit(1.0))


def half_life(rate: Column) -> Column:
    return F.log(F.lit(2.0)) / rate


def compare(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """Difference, percent (0 from 0) and direction."""
    diff = after - before
    percent = F.when(before == 0, F.lit(0.0)).otherwise(diff / before * 100)
    return diff, percent, F.when(diff > 0, "increase").when(diff < 0, "decrease").otherwise("no change")


def moving_average(points: DataFrame, key: str, at: str, value: str, n: int = 3) -> DataFrame:
    """Trailing mean of ``n`` points per key in order of ``at`` (ties by value)."""
    w = Window.partitionBy(key).orderBy(at, value).rowsBetween(1 - n, 0)
    return points.withColumn("moving", F.avg(value).over(w))


def trend(points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Per key: first and last value in time, their difference, percent and direction, and the number of values
    further than 1.5 population deviations from the mean."""
    s = points.groupBy(key).agg(
        F.min_by(value, F.struct(at, value)).alias("first_value"), F.max_by(value, F.struct(at, value)).alias("last_value"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"), F.count(value).alias("n_points"),
    )
    far = points.join(s.select(key, "mean", "dev"), key).filter((F.col("dev") > 0) & (F.abs(F.col(value) - F.col("mean")) > 1.5 * F.col("dev")))
    far = far.groupBy(key).agg(F.count(F.lit(1)).alias("n_outliers"))
    diff, percent, direction = compare(F.col("first_value"), F.col("last_value"))
    out = s.join(far, key, "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0).cast("long")))
    return out.select(key, "n_points", "first_value", "last_value", diff.alias("diff"), percent.alias("percent"), direction.alias("direction"), "n_outliers")


def line_diff(before: Column, after: Column) -> tuple[Column, Column]:
    """Lines added (each time they stand) and removed."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    return F.filter(b, lambda x: ~F.array_contains(a, x)), F.filter(a, lambda x: ~F.array_contains(b, x))
