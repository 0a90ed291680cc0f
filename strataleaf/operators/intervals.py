"""Continuous periods and gaps of intervals, by dyadic blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import end_micros, micros
from strataleaf.operators.history import latest_versions
from strataleaf.operators.slices import HOT_ROWS, SLICES, add_slices
from strataleaf.session import materialise

FOREVER = (1 << 63) - 1


def dyadic_blocks(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """Canonical dyadic blocks of the integer intervals [lo, hi): at level k, the indices i of [i·2^k, (i+1)·2^k)."""
    levels = []
    while len(lo):
        out = [lo[(lo & 1) == 1], hi[(hi & 1) == 1] - 1]
        lo, hi = (lo + 1) >> 1, hi >> 1
        levels.append(np.unique(np.concatenate(out)))
        keep = lo < hi
        lo, hi = lo[keep], hi[keep]
    return levels


def merge_blocks(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal ranges covered by the blocks: drop blocks under an ancestor, merge siblings, coalesce."""
    kept: list[np.ndarray] = [np.empty(0, np.int64)] * (len(levels) + 64)
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k]
        for j in range(k + 1, len(levels)):
            if len(own) and len(kept[j]):
                own = own[~np.isin(own >> (j - k), kept[j])]
        kept[k] = own
    starts, ends, k = [], [], 0
    while k < len(levels) or len(kept[k]):
        own = kept[k]
        even = own[(own & 1) == 0]
        pair = even[np.isin(even + 1, own)]
        if len(pair):
            kept[k + 1] = np.unique(np.concatenate([kept[k + 1], pair >> 1]))
            own = own[~np.isin(own, np.concatenate([pair, pair + 1]))]
        starts.append(own << k)
        ends.append((own + 1) << k)
        k += 1
    lo, hi = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] != hi[:-1]
    last = np.ones(len(lo), bool)
    last[:-1] = first[1:]
    return lo[first], hi[last]


def merge_groups(group: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, from, to, overlapped) of intervals [s, e) with n rows each, groups numbered without order.

    Endpoints become ranks, so a block costs no more levels than the batch has endpoints; a group's last
    endpoint is a cell that nothing covers, so groups never touch."""
    g2, t2 = np.concatenate([group, group]), np.concatenate([s, e])
    order = np.lexsort((t2, g2))
    g2, t2 = g2[order], t2[order]
    new = np.ones(len(g2), bool)
    new[1:] = (g2[1:] != g2[:-1]) | (t2[1:] != t2[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    g2, t2 = g2[new], t2[new]
    lo, hi = rank[: len(s)], rank[len(s) :]
    a, b = merge_blocks(dyadic_blocks(lo, hi))
    span = np.searchsorted(a, lo, side="right") - 1
    cells = np.bincount(span, weights=(hi - lo) * n, minlength=len(a))
    return g2[a], t2[a], t2[b], cells > (b - a)


def _local_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (node_id, slice_id); a group that reaches a batch's end waits for the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        node, slc = t["node_id"].combine_chunks(), t["slice_id"].to_numpy()
        same = np.zeros(len(slc), bool)
        same[1:] = pa.compute.equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False) & (slc[1:] == slc[:-1])
        cut = int(np.flatnonzero(~same)[-1])
        if cut and t.num_rows > 5_000:
            yield from _spans(t.slice(0, cut), same[:cut])
            rest = t.slice(cut)
        else:
            rest = t
    if rest is not None and rest.num_rows:
        node, slc = rest["node_id"].combine_chunks(), rest["slice_id"].to_numpy()
        same = np.zeros(len(slc), bool)
        same[1:] = pa.compute.equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False) & (slc[1:] == slc[:-1])
        yield from _spans(rest, same)


def _spans(t: pa.Table, same: np.ndarray) -> Iterator[pa.RecordBatch]:
    gid = np.cumsum(~same) - 1
    g, a, b, over = merge_groups(gid, t["s"].to_numpy(), t["e"].to_numpy(), t["n"].to_numpy())
    before = np.full(len(g), -1, np.int64)
    before[1:] = np.where(g[1:] == g[:-1], b[:-1], -1)
    known = np.zeros(len(g), bool)
    known[1:] = g[1:] == g[:-1]
    head = t.take(pa.array(np.flatnonzero(~same)[g]))
    yield pa.RecordBatch.from_arrays(
        [
            head["node_id"].combine_chunks(),
            head["slice_id"].combine_chunks(),
            head["hot"].combine_chunks(),
            pa.array(a),
            pa.array(b),
            pa.array(over),
            pa.array(before, mask=~known),
        ],
        names=["node_id", "slice_id", "hot", "from_us", "to_us", "over", "before_us"],
    )


def merged_and_gaps(intervals: DataFrame, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """Spans and holes of half-open integer intervals (node_id, s, e): (node_id, kind, from_us, to_us).

    kind ``merged``: a continuous span (overlapping or touching intervals) where at least two rows share a
    stretch of positive length; ``gap``: from a span's end to the node's next start. FOREVER as an end gives -1.

    * Null keys or ends and intervals that aren't positive are left out; an empty table gives no rows.
    * The same interval in two rows counts as overlapping.
    * Nodes with more than ``hot_rows`` rows are cut into ``slices`` along the starts; slices are merged alone
      and then stitched with the furthest end of all slices before, one number a slice."""
    rows = intervals.filter("node_id is not null and s < e").groupBy("node_id", "s", "e").agg(F.count(F.lit(1)).alias("n"))
    rows = add_slices(rows, "node_id", "s", hot_rows, slices)
    spans = (
        rows.repartition("node_id", "slice_id")
        .sortWithinPartitions("node_id", "slice_id")
        .select("node_id", "slice_id", "hot", "s", "e", "n")
        .mapInArrow(_local_spans, "node_id string, slice_id int, hot boolean, from_us long, to_us long, over boolean, before_us long")
    )
    spans = materialise(spans, "spans")
    cold, hot = spans.filter(~F.col("hot")), stitch(spans.filter("hot"))
    both = cold.select("node_id", "from_us", "to_us", "over", "before_us").unionByName(hot)
    merged = both.filter("over").select("node_id", F.lit("merged").alias("kind"), "from_us", "to_us")
    gaps = both.filter("before_us is not null").select("node_id", F.lit("gap").alias("kind"), F.col("before_us").alias("from_us"), F.col("from_us").alias("to_us"))
    return merged.unionByName(gaps).withColumn("to_us", F.when(F.col("to_us") == FOREVER, -1).otherwise(F.col("to_us")))


def stitch(spans: DataFrame) -> DataFrame:
    """Spans of keys in slices, joined across slices. A span that starts at or before the furthest end of the
    slices before it belongs to the span that runs on there; all others start one."""
    before = Window.partitionBy("node_id").orderBy("slice_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.groupBy("node_id", "slice_id").agg(F.max("to_us").alias("m")).withColumn("reach", F.max("m").over(before))
    s = spans.join(reach.drop("m"), ["node_id", "slice_id"])
    s = s.withColumn("starts", F.coalesce(F.col("from_us") > F.col("reach"), F.lit(True)))
    s = s.withColumn("over", F.col("over") | F.coalesce(F.col("from_us") < F.col("reach"), F.lit(False)))
    s = s.withColumn("own", F.when(F.col("starts"), F.col("from_us")))
    s = s.withColumn("before_us", F.when(F.col("starts"), F.greatest("before_us", "reach")))
    last = s.groupBy("node_id", "slice_id").agg(F.max("own").alias("m")).withColumn("carried", F.max("m").over(before))
    in_slice = Window.partitionBy("node_id", "slice_id").orderBy("from_us")
    s = s.join(last.drop("m"), ["node_id", "slice_id"])
    s = s.withColumn("island", F.coalesce(F.last("own", ignorenulls=True).over(in_slice), "carried"))
    return (
        s.groupBy("node_id", "island")
        .agg(F.max("to_us").alias("to_us"), F.max("over").alias("over"), F.max("before_us").alias("before_us"))
        .withColumnRenamed("island", "from_us")
        .select("node_id", "from_us", "to_us", "over", "before_us")
    )


def version_spans(versions: DataFrame, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """:func:`merged_and_gaps` of the stored spans of node_versions.

    The latest updated_at of a version_id counts; rows without node_id, version_id or effective_from, with
    validity_status ``ARCHIVED`` or an end at or before the start are left out; a null or 9999-12-31 end is open."""
    rows = latest_versions(
        versions.select(
            "version_id", "updated_at", "node_id", micros("effective_from").alias("s"), F.coalesce(end_micros("effective_to"), F.lit(FOREVER)).alias("e"),
            F.coalesce(F.col("validity_status") == "ARCHIVED", F.lit(False)).alias("arch"),
        ),
        *("node_id", "s", "e", "arch"),
    )
    return merged_and_gaps(rows.filter("s is not null and not arch").select("node_id", "s", "e"), hot_rows, slices)
