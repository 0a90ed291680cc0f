"""Texts and files as byte ranges with halos: cut without decoding, decoded range by range."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range's halo before it: a whole character ends in them.
LEAD = 4
_RANGES = "no int, n_ranges int, ended boolean, raw binary"


def byte_ranges(rows: DataFrame, text: str, size: int, after: int) -> DataFrame:
    """``rows`` with ``text`` replaced by its ranges, a row each: (no, n_ranges, ended, raw).

    Range ``no`` has the bytes from no·size - LEAD to (no+1)·size + ``after``, as far as the text goes; ``ended`` says
    that the text ends in them. A null or empty text is one empty range. The slices are made where the row is read,
    as one array, so that no row carries the whole text besides."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    n = F.length(raw).cast("long")
    count = F.greatest(F.ceil(n / size), F.lit(1)).cast("int")

    def cut(i: Column) -> Column:
        start = F.greatest(i.cast("long") * size - LEAD, F.lit(0).cast("long"))
        stop = i.cast("long") * size + size + after
        return F.struct(
            i.alias("no"), count.alias("n_ranges"), (stop >= n).alias("ended"), F.substring(raw, (start + 1).cast("int"), (stop - start).cast("int")).alias("raw")
        )

    others = [c for c in rows.columns if c != text]
    parts = F.explode(F.transform(F.sequence(F.lit(0), count - 1), cut)).alias("__r")
    return rows.select(*others, parts).select(*others, "__r.*")


def file_ranges(spark: SparkSession, paths: list[str], size: int, after: int) -> DataFrame:
    """(row, no, n_ranges, ended, raw) of UTF-8 files, row being the path: each worker opens a file and reads only
    its ranges' bytes. Paths may be local or URIs that pyarrow's file systems know."""
    from pyarrow.fs import FileSystem

    def opened(path: str):
        return FileSystem.from_uri(path) if "://" in path else FileSystem.from_uri("file://" + path)

    found = []
    for p in paths:
        fs, at = opened(p)
        found.append((p, fs.get_file_info(at).size))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n, no in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, at = opened(path)
                start, stop = max(no * size - LEAD, 0), min((no + 1) * size + after, n)
                with fs.open_input_file(at) as f:
                    raw = f.read_at(stop - start, start)
                values = (path, pa.string()), (no, pa.int32()), (max(1, math.ceil(n / size)), pa.int32()), (stop >= n, pa.bool_()), (raw, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=["row", "no", "n_ranges", "ended", "raw"])

    plan = spark.createDataFrame(found, "row string, n long")
    last = F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("int") - 1
    plan = plan.select("row", "n", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    return plan.repartition("row", "no").mapInArrow(read, f"row string, {_RANGES}")


def decoded(raw: bytes, no: int, size: int) -> tuple[str, str, str, int]:
    """(the character before, the range's own characters, those of its halo, place of its first byte in the text).
    A range owns the characters whose first byte lies in its ``size`` bytes."""
    lead = min(LEAD, no * size)

    def whole(at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    a, z = whole(lead), whole(lead + size)
    before = raw[:a].decode("utf-8", "ignore")[-1:]
    return before, raw[a:z].decode("utf-8", "replace"), raw[z:].decode("utf-8", "ignore"), no * size - lead + a
