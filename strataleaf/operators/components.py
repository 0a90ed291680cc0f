"""Connected components of an edge list, without gathering links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.session import drop, materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's edges to stars around the least node of each of its components: the same connections, fewer rows."""
    for b in batches:
        a, z = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, ends = np.unique(np.concatenate([a, z]), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = label.copy()
            np.minimum.at(low, label[x], label[y])
            np.minimum.at(low, label[y], label[x])
            low = low[low[low]]
            low = low[label] if len(low) else low
            if (low == label).all():
                break
            label = low
        away = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[label[away]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node in edges (u, v) of bigint; component is its least node.

    Null ends and self-loops are left out, edges may repeat and point either way; an empty table gives no rows.
    Each task first reduces its batches to stars; then large-star and small-star steps alternate until
    the edge set no longer changes, about the logarithm of the longest path times. Minima are found map-side,
    and the join that hands a node's minimum to its edges has one row a node, so the runtime skew join can
    split a node with a third of all edges."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialise(e.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
        small = small.select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).filter("u <> v").distinct()
        before, e = e, materialise(small, "edges")
        drop(before)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.coalesce(F.sum(h.bitwiseAND(F.lit((1 << 32) - 1))), F.lit(0))).first())
