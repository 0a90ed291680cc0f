"""Groups of near-copies by the pigeonhole principle over the bits of hashed word triples.

The general form, multi-bit parts of correlated bits with unequal thresholds, was measured and costs more (README), so parts are
single bits here, with threshold 0 where they are probed and -1 where they are not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataleaf.llm.words import words
from strataleaf.operators.components import components
from strataleaf.session import materialise

#: Likeness is at least TENTHS/10; words in a shingle; words a text needs.
TENTHS, SHINGLE, MIN_WORDS = 7, 3, 20
#: Cells of the frequency table; rows of a bucket from which it is cut into blocks of about that size.
CELLS, HOT = 1 << 20, 4_000


class _Numbers(dict):
    """64-bit numbers of words, made when first asked for."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        self[w] = x = xxhash.xxh64_intdigest(w)
        return x


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], k: int, least: int, numbers: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word runs of ``k`` of each text with at least ``least`` words, sorted."""
    lists = [words(t) if t else [] for t in texts]
    size = np.array([len(w) if len(w) >= least else 0 for w in lists], np.int64)
    flat = np.fromiter((numbers[w] for ws in lists if len(ws) >= least for w in ws), np.uint64, int(size.sum()))
    owner = np.repeat(np.arange(len(texts)), size)
    m = len(flat) - k + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + m])
    ok = owner[:m] == owner[k - 1 :]
    own, h = owner[:m][ok], h[ok]
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new]


def _set_rows(batches: Iterator[pa.RecordBatch], k: int, least: int, with_bits: bool) -> Iterator[pa.RecordBatch]:
    """Last column, the text, to set_id (null if the text has too few words) and, if asked for, the set's hashes."""
    numbers = _Numbers()
    for b in batches:
        own, h = shingle_sets(b.column(b.num_columns - 1).to_pylist(), k, least, numbers)
        count = np.bincount(own, minlength=b.num_rows)
        ends = np.concatenate([[0], np.cumsum(count)])
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(_mix(h + np.uint64(0xA24BAED4963EE407)), out=sums[1:])
        ids = _mix(sums[ends[1:]] - sums[ends[:-1]] + count.astype(np.uint64)).view(np.int64)
        out = [*b.columns[:-1], pa.array(ids, mask=count == 0)]
        names = [*b.schema.names[:-1], "set_id"]
        if with_bits:
            bits = pa.array(h.view(np.int64))
            out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), bits))
            names.append("bits")
        yield pa.RecordBatch.from_arrays(out, names=names)


def _signatures(batches: Iterator[pa.RecordBatch], cost: np.ndarray, tenths: int) -> Iterator[pa.RecordBatch]:
    """(set_id, component, bits) to a row for each bit that is probed: the n - ceil(t·n) + 1 cheapest bits."""
    for b in batches:
        lists = b.column(2)
        n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        bits = lists.flatten().to_numpy()
        own = np.repeat(np.arange(len(n)), n)
        price = cost[bits & (CELLS - 1)]
        order = np.lexsort((bits, price, own))
        rank = np.arange(len(bits)) - np.repeat(np.cumsum(n) - n, n)
        take = order[rank < (n - (tenths * n + 9) // 10 + 1)[own]]
        masks = np.zeros((len(n), 2), np.uint64)
        place = _mix(bits.view(np.uint64)) % np.uint64(128)
        np.bitwise_or.at(masks, (own, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        at = own[take]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bits[take]),
                pa.array(b.column(0).to_numpy()[at]),
                pa.array(b.column(1).to_numpy()[at]),
                pa.array(n[at].astype(np.int32)),
                *(pa.array(np.ascontiguousarray(masks[:, w]).view(np.int64)[at]) for w in (0, 1)),
                pa.array(price[take].astype(np.int64)),
            ],
            names=["bit", "set_id", "component", "n", "mask", "mask2", "price"],
        )


def _may_be_alike(n: np.ndarray, mask: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, tenths: int) -> np.ndarray:
    """Sizes and 128-bit masks allow the likeness: bits that differ are at most what sets so alike can differ in."""
    a, b = n[i], n[j]
    differ = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in mask)
    return (10 * np.minimum(a, b) >= tenths * np.maximum(a, b)) & ((10 + tenths) * differ <= (10 - tenths) * (a + b))


def _bucket_batches(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by bucket (the first ``keys`` columns), whole buckets at a time, with the buckets' starts."""
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in range(keys):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        new[:1] = True
        return np.flatnonzero(new)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, int(s[-1])), s[:-1]
            rest = t.slice(int(s[-1]))
        else:
            rest = t
    if rest is not None and rest.num_rows:
        yield rest, starts(rest)


def _pairs(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    if len(a):
        a, b = np.unique(np.stack([a, b]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def _linked(batches: Iterator[pa.RecordBatch], tenths: int) -> Iterator[pa.RecordBatch]:
    """Each row of a bucket with the bucket's first and the two rows before it, if they may be alike."""
    for t, s in _bucket_batches(batches, 2):
        ids, n, *mask = (t[c].to_numpy() for c in ("set_id", "n", "mask", "mask2"))
        mask, at = tuple(m.view(np.uint64) for m in mask), np.arange(t.num_rows)
        first = np.repeat(s, np.diff(np.append(s, t.num_rows)))
        i = np.concatenate([at, at, at])
        j = np.concatenate([first, np.maximum(at - 1, first), np.maximum(at - 2, first)])
        ok = i != j
        i, j = i[ok], j[ok]
        ok = _may_be_alike(n, mask, i, j, tenths)
        yield _pairs(ids, i[ok], j[ok])


def _crossing(batches: Iterator[pa.RecordBatch], tenths: int) -> Iterator[pa.RecordBatch]:
    """All pairs of a bucket that lie in different components and may be alike. In a bucket of two blocks
    (``part`` 0 and 1) only pairs across them."""
    for t, s in _bucket_batches(batches, 3):
        ids, comp, n, part, *mask = (t[c].to_numpy() for c in ("set_id", "component", "n", "part", "mask", "mask2"))
        mask = tuple(m.view(np.uint64) for m in mask)
        size = np.diff(np.append(s, t.num_rows))
        own = np.repeat(np.arange(len(s)), size)
        varied = np.minimum.reduceat(comp, s) != np.maximum.reduceat(comp, s)
        two = np.maximum.reduceat(part, s) == 1
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            ok = (comp[i] != comp[j]) & ~(two[own[i]] & (part[i] == part[j]))
            i, j = i[ok], j[ok]
            ok = _may_be_alike(n, mask, i, j, tenths)
            left.append(i[ok])
            right.append(j[ok])

        at = np.flatnonzero(varied[own] & (size[own] <= 64))
        for d in range(1, 64):
            at = at[at + d < t.num_rows]
            at = at[own[at + d] == own[at]]
            if not len(at):
                break
            keep(at, at + d)
        for g in np.flatnonzero(varied & (size > 64)):
            rows = np.arange(s[g], s[g] + size[g])
            for k in rows[:-1]:
                later = np.arange(k + 1, rows[-1] + 1)
                keep(np.full(len(later), k), later)
                if sum(map(len, left)) > 500_000:
                    yield _pairs(ids, np.concatenate(left), np.concatenate(right))
                    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        yield _pairs(ids, np.concatenate(left), np.concatenate(right))


_SIGNATURE = "bit long, set_id long, component long, n int, mask long, mask2 long, price long"


def _alike(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The exact check: of pairs (u, v) those whose sets have at least the likeness."""
    a = sets.select(F.col("set_id").alias("u"), F.col("bits").alias("a"))
    b = sets.select(F.col("set_id").alias("v"), F.col("bits").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").filter((10 + tenths) * both >= tenths * (F.size("a") + F.size("b"))).select("u", "v")


def alike_sets(sets: DataFrame, tenths: int = TENTHS, hot: int = HOT) -> DataFrame:
    """(node, component) of the sets (set_id, bits) that are like another. Bits and sets are told apart by 64-bit hashes: a
    verdict can be wrong only if two triples of a pair collide, about n·n / 2^64, and only in a pair at the limit.

    Pigeonhole: two sets with likeness t differ in at most n - ceil(t·n) of a set's n bits, so among any bits one more
    than that is one which both have, if both take them from one order of all bits. The order is by estimated candidates, from
    one table of CELLS counts over all sets, so the bits that are probed are the rarest. As parts are single bits, which can
    only match or not, there is no allocation to be optimised beyond that choice. Probed rows meet in buckets by bit.

    First each row of a bucket is verified against the bucket's first and the two before it, and components are
    found; near-copies by the thousand collapse here with a few links each. Then all pairs of a bucket between
    different components that sizes and masks allow are verified: no pair is lost, and none within a component
    is looked at. Buckets over ``hot`` rows are cut into blocks; the blocks' first rows are linked with each
    other, and in the second step each two blocks meet in a bucket of their own."""
    cells = sets.select(F.explode("bits").alias("b")).groupBy(F.col("b").bitwiseAND(F.lit(CELLS - 1)).cast("int").alias("c")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    cells = cells.toArrow()
    cost = np.zeros(CELLS, np.int32)
    cost[cells["c"].to_numpy()] = cells["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(cost)

    def signatures(rows: DataFrame) -> DataFrame:
        return rows.select("set_id", "component", "bits").mapInArrow(lambda it: _signatures(it, shared.value, tenths), _SIGNATURE)

    rows = signatures(sets.withColumn("component", F.col("set_id")))
    heavy = rows.filter(F.col("price") > hot).groupBy("bit").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot)
    heavy = materialise(heavy.select("bit", F.ceil(F.col("c") / hot).cast("int").alias("blocks")), "heavy")
    any_heavy = not heavy.isEmpty()

    def in_blocks(rows: DataFrame) -> DataFrame:
        if not any_heavy:
            return rows.withColumn("blocks", F.lit(1)).withColumn("block", F.lit(0))
        rows = rows.join(heavy, "bit", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return rows.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))

    placed = in_blocks(rows).select("bit", "block", "blocks", "set_id", "n", "mask", "mask2")
    if any_heavy:
        one = placed.filter("blocks > 1").groupBy("bit", "block").agg(F.min(F.struct("set_id", "n", "mask", "mask2")).alias("f"))
        placed = placed.unionByName(one.select("bit", F.lit(-1).alias("block"), F.lit(1).alias("blocks"), "f.*"))
    buckets = placed.drop("blocks").repartition("bit", "block").sortWithinPartitions("bit", "block", "set_id")
    pairs = materialise(buckets.mapInArrow(lambda it: _linked(it, tenths), "u long, v long").distinct(), "pairs")
    links = materialise(_alike(pairs, sets, tenths), "links")

    label = components(links).withColumnRenamed("node", "set_id")
    label = materialise(label, "labels")
    rows = signatures(sets.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
    placed = in_blocks(rows).select("bit", "block", "blocks", "set_id", "component", "n", "mask", "mask2")
    whole = placed.filter("blocks = 1").select("bit", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("part"), "set_id", "component", "n", "mask", "mask2")
    if any_heavy:
        parted = placed.filter("blocks > 1")
        varied = parted.groupBy("bit").agg(F.min("component").alias("a"), F.max("component").alias("z")).filter("a <> z").select("bit")
        parted = parted.join(varied, "bit", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        x, y = F.least("block", "other"), F.greatest("block", "other")
        part = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
        whole = whole.unionByName(parted.select("bit", x.alias("x"), y.alias("y"), part.alias("part"), "set_id", "component", "n", "mask", "mask2"))
    buckets = whole.repartition("bit", "x", "y").sortWithinPartitions("bit", "x", "y")
    pairs = materialise(buckets.mapInArrow(lambda it: _crossing(it, tenths), "u long, v long").distinct(), "pairs")
    more = materialise(_alike(pairs, sets, tenths), "crossing")
    if more.isEmpty():
        return label.withColumnRenamed("set_id", "node")
    stars = label.select(F.col("set_id").alias("u"), F.col("component").alias("v")).filter("u <> v")
    return components(stars.unionByName(more))


def near_copies(versions: DataFrame, tenths: int = TENTHS, shingle: int = SHINGLE, least: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """(group_id, version_id): groups of two or more versions linked by likeness, directly or through others.

    Two contents of at least ``least`` words are alike if their distinct runs of ``shingle`` words have a Jaccard
    index of at least ``tenths``/10; group_id is the group's least version_id.

    Of several rows of a version_id the latest updated_at counts (tie: the greatest set). Rows without version_id,
    null and short contents are in no group; an empty table gives no rows. Contents with equal sets are one set
    from the start, so a third of all rows may be copies."""
    src = versions.filter(F.col("version_id").isNotNull())
    src = src.select("version_id", "updated_at", "content")
    kind = T.StructType([*src.schema.fields[:2], T.StructField("set_id", T.LongType())])
    keyed = src.mapInArrow(lambda it: _set_rows(it, shingle, least, False), kind)
    member = keyed.groupBy("version_id").agg(F.max(F.struct("updated_at", "set_id")).alias("v")).select("version_id", "v.set_id")
    member = materialise(member.filter("set_id is not null"), "members")
    found = src.select("content").mapInArrow(lambda it: _set_rows(it, shingle, least, True), "set_id long, bits array<long>")
    sets = found.filter("set_id is not null").groupBy("set_id").agg(F.first("bits").alias("bits"))
    sets = materialise(sets.join(member.select("set_id").distinct(), "set_id", "left_semi"), "sets")
    label = alike_sets(sets, tenths, hot).withColumnRenamed("node", "set_id")
    in_set = member.join(label, "set_id", "left").select("version_id", F.coalesce("component", "set_id").alias("c"))
    in_set = materialise(in_set, "grouped")
    group = in_set.groupBy("c").agg(F.min("version_id").alias("group_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return in_set.join(group, "c").select("group_id", "version_id")
