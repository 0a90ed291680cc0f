"""Splitting of hot keys along an ordering column.

Windows over a key put all its rows into one task. A key may hold a third of a table, so keys above a row
limit are cut into slices at approximate quantiles of the ordering column; windows then run per (key, slice)
and a summary of a row a slice carries what neighbouring slices must know of each other.
Slices are monotone in the ordering column, so results don't depend on where the cuts fall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 200_000
#: Slices a key may have; it gets as many as it needs for slices of half of HOT_ROWS.
SLICES = 1024


def add_slices(df: DataFrame, key: str, order: str, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """``df`` with ``slice_id`` (0-based, growing with ``order``) and ``hot`` (the key was cut).

    Keys with at most ``hot_rows`` rows get slice 0. There are at most rows/hot_rows hot keys, each with as many
    cuts as its rows ask for, so the runtime planner broadcasts them if they are few and else joins by shuffle."""
    cuts = F.percentile_approx(order, [i / slices for i in range(1, slices)], 10 * slices)
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    hot = df.join(hot, key, "left_semi").groupBy(key).agg(cuts.alias("__all"), F.count(F.lit(1)).alias("__n"))
    step = F.greatest(F.floor(F.lit(slices * hot_rows / 2) / F.col("__n")), F.lit(1))
    hot = hot.select(key, F.filter("__all", lambda c, i: (i + 1) % step == 0).alias("__cuts"))
    return (
        df.join(hot, key, "left")
        .withColumn("hot", F.col("__cuts").isNotNull())
        .withColumn("slice_id", F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(order)))))
        .drop("__cuts")
    )


def running(df: DataFrame, key: str, order: str, sums: dict[str, str], prefix: int = 2) -> DataFrame:
    """``df`` with running sums, by new name, of columns in each key in the order of a text column, the row itself included (of
    ties, in any order).

    Sums are made within the key's rows that share their first ``prefix`` characters; what stands before comes from the totals by
    prefix, so a key with many rows is as many tasks as it has prefixes."""
    rows = df.withColumn("__p", F.coalesce(F.substring(order, 1, prefix), F.lit("")))
    before = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "__p").agg(*[F.sum(c).alias(f"__c_{n}") for n, c in sums.items()])
    past = [F.coalesce(F.sum(f"__c_{n}").over(before), F.lit(0).cast("long")).alias(f"__b_{n}") for n in sums]
    counts = counts.select(F.col(key).alias("__k"), F.col("__p").alias("__q"), *past)
    own = Window.partitionBy(key, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__o_{n}": F.sum(c).over(own) for n, c in sums.items()})
    out = out.join(counts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q")))
    return out.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__o_{n}")).cast("long").alias(n) for n in sums])


def numbered(df: DataFrame, key: str, order: str, prefix: int = 2) -> DataFrame:
    """``df`` with ``position``, from 1, of each row in its key in the order of a text column (ties in any order), by :func:`running`."""
    return running(df.withColumn("__one", F.lit(1)), key, order, {"position": "__one"}, prefix).drop("__one")
