"""Pairs of overlapping intervals of one key, without comparing all rows of a key with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a cell, children of a block and levels of blocks: together 358 years from 1900 on; what lies outside falls into the first or last cell.
CELL_DAYS, FAN, LEVELS, FIRST_DAY = 32, 8, 5, -25567


def _cell(at: Column) -> Column:
    day = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date"))
    most = FAN ** (LEVELS - 1) - 1
    return F.greatest(F.least(F.floor((day - FIRST_DAY) / CELL_DAYS).cast("long"), F.lit(most).cast("long")), F.lit(0).cast("long"))


def _at_level(level: int):
    return lambda n: F.struct(F.lit(level).alias("level"), n.alias("no"))


def _blocks(lo: Column, hi: Column) -> Column:
    """The canonical blocks (level, no) that cover the cells [lo, hi]: those within it of which the parent is not."""
    parts = []
    for level in range(LEVELS):
        size, above = FAN**level, FAN ** (level + 1)
        a, z = F.ceil(lo / size).cast("long"), (F.floor((hi + 1) / size) - 1).cast("long")
        pa, pz = F.ceil(lo / above).cast("long") * FAN, F.floor((hi + 1) / above).cast("long") * FAN - 1
        inner = F.lit(level < LEVELS - 1) & (pa <= pz)
        span = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
        nos = F.when(inner, F.concat(span(a, F.least(z, pa - 1)), span(F.greatest(a, pz + 1), z))).otherwise(span(a, z))
        parts.append(F.transform(nos, _at_level(level)))
    return F.concat(*parts)


def overlapping(rows: DataFrame, keys: list[str], ident: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """(keys, a_*, b_*) of each two rows of a key of which b starts (tie: has the greater ident) in a's interval or near its end:
    ``a_start`` <= ``b_start``, and b's start isn't days after a's end. The caller filters exactly. Null keys or starts meet nothing.

    An interval is cut into its canonical blocks of days, a start is in one block of each level, so each such pair meets once, in an
    equi-join by key and block: the work is the pairs that nearly overlap, not all pairs of a key, and a hot key is spread over its
    blocks."""
    at = _cell(F.col(start))
    upto = F.coalesce(_cell(F.col(end)), F.lit(FAN ** (LEVELS - 1) - 1).cast("long"))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in columns]
    rows = rows.filter(F.col(start).isNotNull())
    a = rows.select(*keys, *side("a"), F.explode(_blocks(at, F.greatest(at, upto))).alias("__b")).select("*", "__b.level", "__b.no").drop("__b")
    own = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.floor(at / FAN**level).cast("long").alias("no")) for level in range(LEVELS)])).alias("__b")
    b = rows.select(*keys, *side("b"), own).select("*", "__b.level", "__b.no").drop("__b")
    first = F.struct(f"a_{start}", f"a_{ident}") < F.struct(f"b_{start}", f"b_{ident}")
    return a.join(b, [*keys, "level", "no"]).filter(first).drop("level", "no")
