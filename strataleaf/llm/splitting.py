"""Splitting of oversized texts at natural boundaries, by byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataleaf.functions.ids import norm_id
from strataleaf.llm.ranges import byte_ranges, decoded, file_ranges
from strataleaf.session import materialise

#: A piece's most and least characters, what it repeats of the piece before, and a range's bytes.
LIMIT, LEAST, REPEAT, RANGE = 3000, 1500, 200, 1 << 13
#: Ranges whose boundary tables are stitched in one group; groups are stitched the same way.
FAN = 64


def boundaries(text: str, blank: bool = False) -> list[np.ndarray]:
    """For each kind, best first, the positions just after its boundaries: blank lines, line ends, sentence ends
    and blanks. ``blank``: before ``text`` stands a line end and then at most blanks."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    line, white = c == 10, (c == 32) | (c == 9)
    full = np.flatnonzero(~(white | line | (c == 13)))
    ends = np.flatnonzero(line)
    inner = np.searchsorted(full, ends)
    empty = np.zeros(len(ends), bool)
    empty[1:] = inner[1:] == inner[:-1]
    if blank and len(ends):
        empty[0] = inner[0] == 0
    stop = (c == 46) | (c == 33) | (c == 63)
    after = np.flatnonzero(white[1:] & stop[:-1]) + 1
    sentence = np.union1d(after, np.flatnonzero(c == 0x3002))
    return [ends[empty] + 1, ends + 1, sentence + 1, np.flatnonzero(white) + 1]


def piece_end(kinds: list[np.ndarray], start: int, size: int, limit: int, least: int) -> int:
    """End of the piece from ``start`` in a text (or the rest of one) of ``size`` characters."""
    if size - start <= limit:
        return size
    for at in kinds:
        k = int(np.searchsorted(at, start + limit, side="right"))
        if k and at[k - 1] >= start + least:
            return int(at[k - 1])
    return start + limit


def pieces(text: str, limit: int = LIMIT, least: int = LEAST, repeat: int = REPEAT) -> Iterator[tuple[int, int]]:
    """The pieces of a text that is in memory."""
    kinds, start = boundaries(text), 0
    while True:
        end = piece_end(kinds, start, len(text), limit, least)
        yield start, end
        if end == len(text):
            return
        start = end - repeat


def _all_ends(kinds: list[np.ndarray], starts: int, size: int, limit: int, least: int) -> np.ndarray:
    """:func:`piece_end` of each start from 0 to ``starts``."""
    s = np.arange(starts)
    end = s + limit
    open_ = np.ones(starts, bool)
    for at in kinds:
        if len(at):
            k = np.searchsorted(at, s + limit, side="right")
            last = at[np.maximum(k - 1, 0)]
            hit = open_ & (k > 0) & (last >= s + least)
            end[hit] = last[hit]
            open_ &= ~hit
    return np.where(size - s <= limit, size, end)


def _kinds_of(before: str, text: str, blank: bool) -> list[np.ndarray]:
    """Boundaries of a range and its halo in positions from its start; the character before it only tells a sentence's end."""
    kinds = boundaries(text, blank)
    if before and before in ".!?" and text[:1] in (" ", "\t") and text:
        kinds[2] = np.union1d(kinds[2], [1])
    return kinds


def _columns(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _lengths(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each range's own characters, and what it says of the line that the next range begins in."""
    for b in batches:
        out = []
        for no, raw in _columns(b, "no", "raw"):
            own = decoded(raw, no, size)[1]
            tail = own.rstrip(" \t\r")
            out.append((len(own), not tail, tail.endswith("\n")))
        n, white, ends = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("no"), pa.array(n, pa.int64()), pa.array(white, pa.bool_()), pa.array(ends, pa.bool_())],
            names=["row", "no", "own", "all_white", "ends_blank"],
        )


def _tables(batches: Iterator[pa.RecordBatch], size: int, limit: int, least: int, repeat: int) -> Iterator[pa.RecordBatch]:
    """A range's boundary table: for each place at which a chain of pieces may enter it, how far into the next
    range it gets (-1: the text ends before) and how many pieces start on the way. Jumps are doubled, so all
    entries are followed at once."""
    width = limit - repeat
    for b in batches:
        for row, no, raw, ended, blank in _columns(b, "row", "no", "raw", "ended", "blank"):
            before, own_text, halo, _ = decoded(raw, no, size)
            own = len(own_text)
            seen = own + len(halo)
            # a rest that goes on beyond the halo is longer than any piece
            left = seen if ended else seen + limit + 1
            end = _all_ends(_kinds_of(before, own_text + halo, blank), own, left, limit, least)
            to = np.where(end == left, own + width, end - repeat)
            jump = np.append(np.minimum(to, own), own)
            far = np.append(to, 0)
            count = np.append(np.ones(own, np.int64), 0)
            while own and (jump[:own] < own).any():
                inside = jump < own
                far = np.where(inside, far[jump], far)
                count = count + count[jump]
                jump = jump[jump]
            entry = np.arange(width)
            inner = entry < own
            leave = np.where(inner, far[np.minimum(entry, own)], entry) - own
            leave = np.where(leave >= width, -1, leave)
            passed = np.where(inner, count[np.minimum(entry, own)], 0)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row]), pa.array([no], pa.int32()), pa.array([leave.astype(np.int32)], kind), pa.array([passed.astype(np.int32)], kind)],
                names=["row", "no", "leave", "count"],
            )


def _stitched(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tables of neighbouring ranges as one table."""
    pdf = pdf.sort_values("no")
    at = np.arange(len(pdf["leave"].iloc[0]))
    count = np.zeros(len(at), np.int64)
    for leave, passed in zip(pdf["leave"], pdf["count"], strict=True):
        on = at >= 0
        count[on] += np.asarray(passed)[at[on]]
        at[on] = np.asarray(leave)[at[on]]
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "no": [pdf["up"].iloc[0]], "leave": [at.astype(np.int32)], "count": [count.astype(np.int32)]})


def _followed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain that enters a group of ranges enters each of them, and the pieces before."""
    pdf, out = pdf.sort_values("no"), []
    at, before = int(pdf["entry"].iloc[0]), int(pdf["before"].iloc[0])
    for no, leave, passed in zip(pdf["no"], pdf["leave"], pdf["count"], strict=True):
        out.append((no, at, before))
        before, at = before + int(passed[at]), int(leave[at])
        if at < 0:
            break
    return pd.DataFrame({"row": [pdf["row"].iloc[0]] * len(out), "no": [x[0] for x in out], "entry": [x[1] for x in out], "before": [x[2] for x in out]})


def _entries(tables: DataFrame, most: int, kind: str) -> DataFrame:
    """(row, no, entry, before) of each range a chain enters: tables are stitched upward in groups of FAN until a
    text has one, then followed downward. No task has more than FAN tables of a text."""
    up = (F.col("no") / FAN).cast("int")
    levels = [tables.withColumn("up", up)]
    while most >= FAN:
        most //= FAN
        joined = levels[-1].groupBy("row", "up").applyInPandas(_stitched, f"row {kind}, no int, leave array<int>, count array<int>")
        levels.append(materialise(joined, "stitched").withColumn("up", up))
    entries = levels[-1].select("row", F.lit(0).alias("no"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before")).distinct()
    for level in reversed(levels):
        within = level.join(entries.withColumnRenamed("no", "up"), ["row", "up"])
        entries = within.groupBy("row", "up").applyInPandas(_followed, f"row {kind}, no int, entry int, before long")
    return entries


def _emit(batches: Iterator[pa.RecordBatch], size: int, limit: int, least: int, repeat: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, out = [], []
        for row, no, raw, ended, blank, begin, s, piece in _columns(b, "row", "no", "raw", "ended", "blank", "begin", "entry", "before"):
            before, own_text, halo, _ = decoded(raw, no, size)
            kinds, seen = _kinds_of(before, own_text + halo, blank), len(own_text) + len(halo)
            left = seen if ended else seen + limit + 1
            while s < len(own_text):
                e = piece_end(kinds, s, left, limit, least)
                piece += 1
                rows.append(row)
                out.append((piece, begin + s, begin + e))
                if e == left:
                    break
                s = e - repeat
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, b.schema.field("row").type), *(pa.array(c, pa.int64()) for c in cols)], names=["row", "piece_no", "start_pos", "end_pos"]
        )


def _pieces_of(ranges: DataFrame, limit: int, least: int, repeat: int, size: int) -> DataFrame:
    """Pieces of the texts cut into ``ranges`` (row, no, n_ranges, ended, raw)."""
    kind = ranges.schema["row"].dataType.simpleString()
    cut = materialise(ranges, "ranges")
    lengths = cut.mapInArrow(lambda it: _lengths(it, size), f"row {kind}, no int, own long, all_white boolean, ends_blank boolean")
    before = Window.partitionBy("row").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    blank = F.last(F.when(~F.col("all_white"), F.col("ends_blank")), ignorenulls=True).over(before)
    place = F.coalesce(F.sum("own").over(before), F.lit(0).cast("long"))
    total = F.sum("own").over(Window.partitionBy("row"))
    known = lengths.select("row", "no", F.coalesce(blank, F.lit(False)).alias("blank"), place.alias("begin"), total.alias("n_chars"))
    known = materialise(known.filter(F.col("n_chars") > limit), "lengths")
    most = known.agg(F.max("no")).first()[0]
    if most is None:
        return known.select("row", *(F.lit(0).cast("long").alias(c) for c in ("piece_no", "start_pos", "end_pos"))).limit(0)
    first = known.filter("no = 0").select("row", "no", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))
    several = cut.filter("n_ranges > 1").join(known, ["row", "no"]).select("row", "no", "raw", "ended", "blank")
    tables = several.mapInArrow(lambda it: _tables(it, size, limit, least, repeat), f"row {kind}, no int, leave array<int>, count array<int>")
    entries = first
    if most:
        entries = first.unionByName(_entries(materialise(tables, "tables"), most, kind).filter("no > 0"))
    entered = cut.join(known, ["row", "no"]).join(entries, ["row", "no"]).select("row", "no", "raw", "ended", "blank", "begin", "entry", "before")
    return entered.mapInArrow(lambda it: _emit(it, size, limit, least, repeat), f"row {kind}, piece_no long, start_pos long, end_pos long")


def _checked(limit: int, least: int, repeat: int, size: int) -> int:
    """Bytes of a range's halo: what the last piece to start in it may take, and one character to see that more follows."""
    if not (0 <= repeat < least <= limit and size > 0):
        raise ValueError("0 <= repeat < least <= limit and size > 0")
    return 4 * (limit + 2)


def split_texts(rows: DataFrame, limit: int = LIMIT, least: int = LEAST, repeat: int = REPEAT, size: int = RANGE) -> DataFrame:
    """(row, piece_no, start_pos, end_pos) of the texts of (row, text) with more than ``limit`` characters.

    A piece takes all of a rest of at most ``limit`` characters, else it ends at the last boundary of the best
    kind that occurs from ``least`` to ``limit`` characters on, else after ``limit``; the next starts ``repeat``
    before its end. Null and shorter texts give no rows; ``row`` may be of any type and should be unique.

    Each text is cut into ranges of ``size`` bytes with halos, one if it is short. Workers find the boundaries in
    each range (what it can't see, whether the line before it is blank so far, comes from a window of one flag a range)
    and tabulate where a chain of pieces that enters it anywhere leaves it; the tables are stitched in groups, which
    gives each range its entry; prefix sums of the ranges' lengths turn entries into offsets, by which each range
    emits its pieces. No Python process sees more than a range of a text, or FAN tables."""
    after = _checked(limit, least, repeat, size)
    long = rows.select("row", "text").filter(F.length("text") > limit)
    return _pieces_of(byte_ranges(long, "text", size, after), limit, least, repeat, size)


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, least: int = LEAST, repeat: int = REPEAT, size: int = RANGE) -> DataFrame:
    """As :func:`split_texts` of UTF-8 files, ``row`` being the path; no worker reads more of a file than its ranges."""
    after = _checked(limit, least, repeat, size)
    return _pieces_of(file_ranges(spark, paths, size, after), limit, least, repeat, size)


def split_nodes(nodes: DataFrame, limit: int = LIMIT, least: int = LEAST, repeat: int = REPEAT, size: int = RANGE) -> DataFrame:
    """(node_id, piece_no, start_pos, end_pos) of :func:`split_texts` over apex_ast_nodes.

    Of several rows of a node the one with the latest ingestion_date counts (tie: the greatest node_id, then
    content digest); null and blank ids are none. The row that counts is found by digest, so only contents over
    the limit are moved."""
    digest = F.coalesce(F.md5("content"), F.lit(""))
    rows = nodes.select(norm_id("node_id").alias("key"), "node_id", "ingestion_date", digest.alias("digest"), "content").filter("key is not null")
    last = rows.groupBy("key").agg(F.max(F.struct("ingestion_date", "node_id", "digest")).alias("v"))
    last = last.select(F.col("key").alias("k"), "v.*")
    big = rows.filter(F.length("content") > limit)
    same = (F.col("key") == last["k"]) & rows["ingestion_date"].eqNullSafe(last["ingestion_date"]) & (rows["node_id"] == last["node_id"]) & (rows["digest"] == last["digest"])
    big = big.join(last, same, "left_semi").dropDuplicates(["key"])
    # one row a key is left, so node_id is as unique as the key
    return split_texts(big.select(F.col("node_id").alias("row"), F.col("content").alias("text")), limit, least, repeat, size).withColumnRenamed("row", "node_id")
