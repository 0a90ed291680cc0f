"""Node ids and instants as every operator compares them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = -1


def norm_id(c: Column | str) -> Column:
    """A node id without blanks (U+0020) at both ends, lower-cased; null for a null or blank reference."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(c))
    return F.when(t != "", t)


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp with or without zone (session zone UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def end_micros(c: Column | str) -> Column:
    """As :func:`micros`, null where the end is open (null or on 9999-12-31)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < F.lit("9999-12-31").cast("timestamp_ntz"), micros(c))
