"""Comparison of a query with its SQL twin, as multisets of rows with columns sorted by name."""

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return repr(v) if not isinstance(v, (int, bool)) else str(int(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, folder: str) -> list[str]:
    c = connect(folder)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    rel = c.sql(sql)
    want_names, want = rel.columns, rel.fetchall()
    if sorted(got_names) != sorted(want_names):
        return [f"columns {sorted(got_names)} against {sorted(want_names)}"]
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if a == b:
        return []
    sa, sb = set(a), set(b)
    return [f"{len(a)} rows against {len(b)}; only here {list(sa - sb)[:3]}; only in SQL {list(sb - sa)[:3]}"]
