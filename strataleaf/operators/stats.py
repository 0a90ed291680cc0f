"""Order statistics, conformal thresholds and metric summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices that a key's distinct values are cut into.
SLICES = 64


def ranked_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c, upto, n): each distinct value of a key with its count, the count of values up to it and of all. Null values
    don't count.

    Values are counted map-side first. Running counts are made within slices of a key's values, cut at approximate quantiles, and
    what stands before a slice comes from the slices' totals; so a single key with very many values is as many tasks as slices."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    names = [F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]
    on = reduce(lambda a, b: a & b, same) if same else F.lit(True)
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("v", [i / SLICES for i in range(1, SLICES)], 1000).alias("__cuts")).select(*names, "__cuts")
    sliced = counted.join(cuts, on).drop(*[f"__{i}" for i in range(len(keys))])
    sliced = sliced.withColumn("__s", F.size(F.filter("__cuts", lambda x: x < F.col("v")))).drop("__cuts")
    totals = sliced.groupBy(*keys, "__s").agg(F.sum("c").alias("__c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # at most SLICES rows a key
    before = F.coalesce(F.sum("__c").over(w.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    totals = totals.select(*names, F.col("__s").alias("__t"), before.alias("__before"), F.sum("__c").over(w).alias("n"))
    out = sliced.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "__s").orderBy("v"))).join(totals, on & (F.col("__s") == F.col("__t")))
    return out.select(*keys, "v", "c", (F.col("upto") + F.col("__before")).alias("upto"), "n")


def order_stats(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per key count, mean, min, max and exact order statistics: the value at the 0-based place floor(n·q).

    That isn't percentile_disc where n·q is whole. Places come from :func:`ranked_values`; no list of a key's values is built."""
    ranked = ranked_values(rows, keys, value)
    pick = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("v"))).alias(name) for name, q in quantiles.items()]
    out = [F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most")]
    return ranked.groupBy(*keys).agg(*out, *pick)


def conformal_threshold(rows: DataFrame, keys: list[str], score: str, level: float = 0.9, least: int = 10) -> DataFrame:
    """Per key the k-th least score, k = ceil((n+1)·(1-(1-level))) within 1 and n; 0 with under ``least`` scores."""
    ranked = ranked_values(rows, keys, score)
    k = F.greatest(F.least(F.ceil((F.col("n") + 1) * F.lit(1.0 - (1.0 - level))), F.col("n")), F.lit(1))
    kth = F.min(F.when(F.col("upto") >= k, F.col("v")))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), kth.alias("t")).select(*keys, "n", F.when(F.col("n") < least, 0.0).otherwise(F.col("t")).alias("threshold"))


def coverage(rows: DataFrame, thresholds: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Share of a key's scores that are at most its threshold."""
    hit = F.avg((F.col(score) <= F.col("threshold")).cast("double"))
    return rows.join(thresholds.select(*keys, "threshold"), keys).groupBy(*keys).agg(hit.alias("coverage"))


def nonconformity(strategy: str, retrieval: Column, verified: Column, rank: Column, max_rank: Column) -> Column:
    """inverse_retrieval, verification_gap, rank_based, or their ensemble (.40, .35, .25)."""
    inverse = 1 - retrieval
    gap = F.when(F.coalesce(verified, F.lit(True)), 0.0).otherwise(1.0)
    place = F.when(max_rank <= 0, 1.0).otherwise(F.least(F.lit(1.0), rank / max_rank))
    return {"inverse_retrieval": inverse, "verification_gap": gap, "rank_based": place, "ensemble": 0.40 * inverse + 0.35 * gap + 0.25 * place}[strategy]


def hierarchical_confidence(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


def histogram(rows: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Cumulative counts (keys, le, n) for each upper edge and for infinity, as a text exposition has them."""
    sums = [F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)]
    wide = rows.groupBy(*keys).agg(*sums, F.count(value).alias("binf"))
    cells = [F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("binf").alias("n")))
    return wide.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.le", "x.n")


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of the two token multisets after lower-casing, dropping punctuation and articles; 0 if either is empty."""
    tokens = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", ""), r"\b(a|an|the)\b", " ")), r"\s+"), lambda x: x != "")
    p, t = tokens(prediction), tokens(truth)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    same = F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, x: acc + F.least(count(p, x), count(t, x)))
    return F.when(same > 0, 2.0 * same / (F.size(p) + F.size(t))).otherwise(0.0)
