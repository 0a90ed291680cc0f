"""Bounded traversals of edge lists by frontier joins; nothing is gathered on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.session import materialise


def undirected(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(a, b) both ways, as a union of two projections, so that joins stay equi-joins. Null ends are left out."""
    one = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def hops(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops): the fewest links (a, b) from any seed (node), up to ``depth``. Each round joins the frontier
    alone and drops what was seen before; a hot node is met once."""
    links = materialise(links, "links")
    frontier = materialise(seeds.select("node").filter("node is not null").distinct(), "frontier")
    seen = [frontier.withColumn("hops", F.lit(0).cast("long"))]
    for k in range(1, depth + 1):
        nxt = frontier.join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        nxt = nxt.join(reduce(DataFrame.unionByName, seen).select("node"), "node", "left_anti")
        frontier = materialise(nxt, "frontier")
        seen.append(frontier.withColumn("hops", F.lit(k).cast("long")))
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, seen)


def closure(links: DataFrame, depth: int) -> DataFrame:
    """(source, node, hops): for each node all that directed links (a, b) reach within ``depth``, with the fewest
    links. The result holds each pair once; links of great fan-out make it large by its nature."""
    links = materialise(links.filter("a is not null and b is not null").select("a", "b").distinct(), "links")
    frontier = links.select(F.col("a").alias("source"), F.col("b").alias("node"))
    seen = [frontier.withColumn("hops", F.lit(1).cast("long"))]
    for k in range(2, depth + 1):
        nxt = frontier.join(links, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        nxt = nxt.join(reduce(DataFrame.unionByName, seen).select("source", "node"), ["source", "node"], "left_anti")
        frontier = materialise(nxt, "closure")
        seen.append(frontier.withColumn("hops", F.lit(k).cast("long")))
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, seen)


def cyclic_core(links: DataFrame) -> DataFrame:
    """The links (a, b) that are left when links from nodes without entering or to nodes without leaving links are
    taken away again and again: every cycle, and what lies between cycles. Empty for a graph without cycles."""
    e = materialise(links.filter("a is not null and b is not null").select("a", "b").distinct(), "core")
    n = e.count()
    while True:
        e = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        e = materialise(e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "core")
        left = e.count()
        if left == n:
            return e
        n = left


def on_cycles(links: DataFrame) -> DataFrame:
    """(node) of each node that directed links (a, b) lead back to itself, over one link or more; the length doesn't matter.

    Rounds on what is left of the cyclic core: each node gets the least name that reaches it (``low``); links between
    different ``low`` lie on no cycle, as all nodes of a cycle have the same one. In each class the nodes that reach the one
    it is named after are on a cycle with it and leave; the rest goes on, until nothing is left."""
    loops = links.filter("a = b").select(F.col("a").alias("node"))
    found = [materialise(loops.distinct(), "on-cycles")]
    left = cyclic_core(links.filter("a <> b"))
    while not left.isEmpty():
        low = _least_ancestor(left)
        left = left.join(low.select(F.col("node").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("lb")), "b")
        left = materialise(left.filter("la = lb").select("a", "b", F.col("la").alias("low")), "classes")
        back = frontier = materialise(low.filter("node = low").select("node"), "reached")
        while not frontier.isEmpty():
            nxt = left.join(frontier.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
            frontier = materialise(nxt.join(back, "node", "left_anti"), "frontier")
            back = materialise(back.unionByName(frontier), "reached")
        # A class's name alone, reached by none of its own, is on no cycle; cyclic_core keeps such links between cycles.
        entered = left.select(F.col("b").alias("node")).distinct()
        found.append(materialise(back.join(left.select(F.col("a").alias("node")).distinct(), "node", "left_semi").join(entered, "node", "left_semi"), "on-cycles"))
        rest = left.select("a", "b").join(back.select(F.col("node").alias("a")), "a", "left_anti")
        left = cyclic_core(rest.join(back.select(F.col("node").alias("b")), "b", "left_anti"))
    return reduce(DataFrame.unionByName, found).distinct()


def _least_ancestor(links: DataFrame) -> DataFrame:
    """(node, low) of each node in links (a, b): the least node from which links lead to it, itself included."""
    low = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("low", F.col("node"))
    low = frontier = materialise(low, "low")
    while not frontier.isEmpty():
        offer = links.join(frontier.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("low").alias("offer"))
        both = low.join(offer.withColumnRenamed("b", "node"), "node", "left").withColumn("new", F.coalesce(F.col("offer") < F.col("low"), F.lit(False)))
        both = materialise(both.select("node", F.when(F.col("new"), F.col("offer")).otherwise(F.col("low")).alias("low"), "new"), "low")
        low, frontier = both.select("node", "low"), both.filter("new").select("node", "low")
    return low


def closing(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (s, t, ...) whose target reaches their source over links (a, b), however many; a candidate from a node to
    itself needs a longer way round as well. Only what lies on or between cycles of both together is followed."""
    links = links.filter("a is not null and b is not null").select("a", "b").distinct()
    ends = candidates.filter("s is not null and t is not null")
    core = cyclic_core(links.unionByName(ends.select(F.col("s").alias("a"), F.col("t").alias("b"))))
    core = materialise(core.join(links, ["a", "b"], "left_semi"), "links")
    asked = ends.select(F.col("t").alias("source")).distinct()
    seen = frontier = materialise(asked.join(core, F.col("source") == F.col("a")).select("source", F.col("b").alias("node")).distinct(), "closure")
    while not frontier.isEmpty():
        nxt = frontier.join(core, F.col("node") == F.col("a")).select("source", F.col("b").alias("node")).distinct()
        frontier = materialise(nxt.join(seen, ["source", "node"], "left_anti"), "frontier")
        seen = materialise(seen.unionByName(frontier), "closure")
    return candidates.join(seen.select(F.col("source").alias("t"), F.col("node").alias("s")), ["s", "t"], "left_semi")
