"""References to records that don't exist, found with a blocked Bloom filter of the parents' keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.ids import micros, norm_id
from strataleaf.session import materialise

#: A block has 8 words of 64 bits, one bit set in each; at 40 keys a block about 1 in 1,000 absent keys passes.
#: Filters of up to BROADCAST_BLOCKS (18 MB of words, 10.5 million keys) are broadcast.
WORDS, KEYS_PER_BLOCK, BROADCAST_BLOCKS = 8, 40, 1 << 18


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    place = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in place]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table (block, w0..w7): at most ``blocks`` rows, built by map-side bit_or."""
    k = F.col(key)
    words = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks(k))]
    return keys.groupBy(_block(k, blocks).alias("block")).agg(*words)


def filter_size(n_keys: int) -> int:
    """Blocks for so many keys: the filter grows with them, so it proves the same share of absent keys at any size."""
    want = 1
    while want * KEYS_PER_BLOCK < n_keys:
        want *= 2
    return want


def probe(refs: DataFrame, key: str, filter_: DataFrame, blocks: int, flag: str) -> DataFrame:
    """``refs`` with ``flag``: false proves that the key is absent. A filter of more than BROADCAST_BLOCKS is
    partitioned by block and so are the references; hot ones are left to the runtime skew join, as a block is one row."""
    k = F.col(key)
    f = filter_.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    hit = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(k))])
    out = refs.join(F.broadcast(f) if blocks <= BROADCAST_BLOCKS else f, _block(k, blocks) == F.col("__block"), "left")
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__block", *[f"__w{i}" for i in range(WORDS)])


def references(edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """(ref_table, ref_field, row_id, key, at): each reference once; null, blank and ``entity:`` ones are none."""

    def of(table: DataFrame, name: str, row_id: str, at: str, *fields: str) -> DataFrame:
        refs = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), norm_id(f).alias("key")) for f in fields])).alias("r")
        rows = table.select(F.col(row_id).alias("row_id"), micros(at).alias("at"), refs)
        return rows.select(F.lit(name).alias("ref_table"), "r.ref_field", "row_id", "r.key", "at")

    parts = [
        of(edges, "apex_causal_edges", "edge_id", "discovered_at", "source_node_id", "target_node_id"),
        of(metadata, "apex_temporal_metadata", "node_id", "updated_at", "superseded_by"),
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col("key").isNotNull() & ~F.col("key").startswith("entity:"))


def orphan_references(nodes: DataFrame, versions: DataFrame, edges: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per reference that leads nowhere: (ref_table, ref_field, row_id, reason, period).

    Two Bloom filters, of the keys in nodes and in versions, prove most orphans without a join: a reference
    that neither holds is ``missing``. Only references that a filter lets through are joined exactly.

    * late: the node's first ingestion_date, over all its rows, is after the referring row's time; deleted: not
      in nodes but in versions; missing: in neither. Without a time nothing is late and period is ``unknown``.
    * Node rows without node_id are no node; a node without any ingestion_date is never late.
    * Redelivered referring rows give one row; rows with a null row_id are reported under null.
    * Empty tables: with no references no rows, with no nodes all references are deleted or missing.

    Skew: the exact join keeps each reference (a hot parent may hold a third), so hot keys are left to the
    runtime skew join, which splits the reference side; the parents' side has one row a key."""
    cols = ("ref_table", "ref_field", "row_id")
    node_keys = nodes.select(norm_id("node_id").alias("key"), micros("ingestion_date").alias("first")).filter("key is not null")
    gone_keys = versions.select(norm_id("node_id").alias("key")).filter("key is not null")
    b_live, b_gone = filter_size(nodes.count()), filter_size(versions.count())

    refs = probe(references(edges, metadata), "key", bloom_blocks(node_keys, "key", b_live), b_live, "maybe")
    parents = node_keys.groupBy("key").agg(F.min("first").alias("first"), F.lit(True).alias("found"))
    checked = refs.filter("maybe").join(parents, "key", "left")
    late = F.coalesce(F.col("first") > F.col("at"), F.lit(False))
    open_refs = (
        refs.filter(~F.col("maybe")).select(*cols, "key", "at", F.lit(False).alias("late"))
        .unionByName(checked.filter(F.col("found").isNull() | late).select(*cols, "key", "at", late.alias("late")))
    )
    open_refs = materialise(open_refs, "p2-open")

    dead = probe(open_refs.filter(~F.col("late")), "key", bloom_blocks(gone_keys, "key", b_gone), b_gone, "maybe")
    known = dead.filter("maybe").join(gone_keys.distinct().withColumn("deleted", F.lit(True)), "key", "left")
    parts = [
        open_refs.filter("late").select(*cols, F.lit("late").alias("reason"), "at"),
        dead.filter(~F.col("maybe")).select(*cols, F.lit("missing").alias("reason"), "at"),
        known.select(*cols, F.when(F.col("deleted"), "deleted").otherwise("missing").alias("reason"), "at"),
    ]
    period = F.coalesce(F.date_format(F.timestamp_micros("at"), "yyyy-MM"), F.lit("unknown"))
    return reduce(DataFrame.unionByName, parts).select(*cols, "reason", period.alias("period")).distinct()


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """The report: references per table, field, reason and month of :func:`orphan_references`."""
    return orphans.groupBy("ref_table", "ref_field", "reason", "period").agg(F.count(F.lit(1)).alias("n_refs"))
