"""The general problems against plain Python on small tables with nulls, ties, repeated rows, hot keys and
columns whose names clash with the operators' own."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataleaf.operators.components import components
from strataleaf.operators.hierarchy import descendants, hierarchy, node_hierarchy
from strataleaf.operators.history import scd2_merge, version_periods
from strataleaf.operators.intervals import merge_groups, merged_and_gaps, version_spans
from strataleaf.operators.orphans import bloom_blocks, filter_size, orphan_references, probe
from strataleaf.session import materialise

T0 = datetime(2024, 1, 1)
VERSIONS = (
    "version_id string, node_id string, content string, created_at timestamp_ntz, updated_at timestamp_ntz, effective_from timestamp_ntz,"
    " effective_to timestamp_ntz, version_number int, validity_status string, `slice_id` string, `key` int, `hot` int, `digest` string"
)


def us(t):
    return int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def random_versions(seed, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = None if r.random() < 0.05 else T0 + timedelta(hours=r.randrange(60))
        end = r.choice([None, datetime(9999, 12, 31), T0 + timedelta(hours=r.randrange(70))])
        node = r.choice([None, "hot", "hot", "hot", "a", "b", "c"])
        row = (r.choice([f"v{i}", f"v{i}", f"v{i - 1}"]), node, r.choice(["x", "y", "", None]), T0 + timedelta(minutes=i), T0 + timedelta(minutes=r.randrange(9)),
            start, end, i, r.choice(["ACTIVE", "ACTIVE", "ARCHIVED", None]), "s", 1, 2, "d")
        rows += [row] * r.choice([1, 1, 1, 2])
    return rows


def latest(rows, fields):
    """By the operators' rule: updated_at, then the fields in order, nulls least."""
    low = lambda v: (v is not None, v if v is not None else 0)
    best = {}
    for x in rows:
        if x[0] is not None:
            k = (low(x[4]), *[low(f(x)) for f in fields])
            if x[0] not in best or k > best[x[0]][0]:
                best[x[0]] = (k, x)
    return [x for _, x in best.values()]


def plain_periods(rows):
    import hashlib

    dig = lambda x: hashlib.md5(x[2].encode()).digest() if x[2] is not None else b""
    fields = [lambda x: x[1], lambda x: x[5] and us(x[5]), lambda x: us(x[3]), lambda x: x[7], lambda x: x[8] == "ARCHIVED", dig]
    out = set()
    by = {}
    for x in latest(rows, fields):
        if x[1] is not None and x[5] is not None:
            k = (x[1], us(x[5]))
            if k not in by or (x[3], x[7], x[0]) > (by[k][3], by[k][7], by[k][0]):
                by[k] = x
    for node in {k[0] for k in by}:
        run = None
        for (_, at), x in sorted((k, x) for k, x in by.items() if k[0] == node):
            if run and (x[8] == "ARCHIVED" or run[2] != x[2]):
                out.add((run[0], run[1], at))
                run = None
            if x[8] != "ARCHIVED" and not run:
                run = (x[0], at, x[2])
        if run:
            out.add((run[0], run[1], -1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_periods(spark, seed):
    rows = random_versions(seed)
    df = spark.createDataFrame(rows, VERSIONS)
    for hot in (1000, 10):
        got = {(r.version_id, r.from_us, r.to_us) for r in version_periods(df, hot, 5).collect()}
        assert got == plain_periods(rows)


def test_periods_of_nothing(spark):
    empty = spark.createDataFrame([], VERSIONS)
    assert version_periods(empty).count() == 0
    assert version_spans(empty).count() == 0


def starts(dimension):
    return {(r.version_id, r.eff, r.to_us) for r in dimension.filter("to_us is not null").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_merge_of_batches(spark, seed):
    """However the log is split, late rows, archives, corrections and redelivered rows included."""
    rows = random_versions(seed, 90)
    random.Random(seed).shuffle(rows)
    n, dimension, done = random.Random(seed).choice([2, 3]), None, []
    for k in range(n):
        part = rows[k::n]
        done += part
        dimension = materialise(scd2_merge(dimension, spark.createDataFrame(part, VERSIONS), 1000 if seed % 2 else 10, 8))
        assert starts(dimension) == plain_periods(done)
    again = scd2_merge(dimension, spark.createDataFrame(rows[:30], VERSIONS))
    assert starts(again) == starts(dimension)
    assert starts(scd2_merge(dimension, spark.createDataFrame([], VERSIONS))) == starts(dimension)


def test_merge_of_a_late_row(spark):
    """A prolonging row is kept, so a late row between can't erase it."""
    row = lambda v, c, h: (v, "n", c, T0 + timedelta(minutes=h), T0, T0 + timedelta(hours=h), None, h, "ACTIVE", "s", 1, 2, "d")
    dimension = scd2_merge(None, spark.createDataFrame([row("a1", "A", 1), row("a5", "A", 5)], VERSIONS))
    got = scd2_merge(dimension, spark.createDataFrame([row("b3", "B", 3)], VERSIONS))
    at = lambda h: us(T0 + timedelta(hours=h))
    assert starts(got) == {("a1", at(1), at(3)), ("b3", at(3), at(5)), ("a5", at(5), -1)}


def plain_spans(rows):
    out = set()
    for node in {n for n, _, _ in rows if n is not None}:
        iv = sorted((s, e) for n, s, e in rows if n == node and s is not None and e is not None and s < e)
        spans = []
        for s, e in iv:
            if spans and s <= spans[-1][1]:
                spans[-1][2] |= s < spans[-1][1]
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e, False])
        out |= {(node, "merged", s, e) for s, e, over in spans if over}
        out |= {(node, "gap", a[1], b[0]) for a, b in zip(spans, spans[1:])}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spans(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, "a", "b", "hot", "hot"]), r.choice([None, *range(300)]), r.choice([None, *range(300)])) for _ in range(150)]
    rows = [(n, s, s + abs(e - s) % (9 if seed % 2 else 90) if s is not None and e is not None else e) for n, s, e in rows]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "node_id string, s long, e long")
    for hot in (1000, 12):
        assert {tuple(x) for x in merged_and_gaps(df, hot, 6).collect()} == plain_spans(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50), st.integers(1, 40)), min_size=1, max_size=40))
def test_dyadic_merge(rows):
    import numpy as np

    g, s, w = (np.array(x, np.int64) for x in zip(*rows))
    got = {(int(a), int(b), int(c), bool(o)) for a, b, c, o in zip(*merge_groups(g, s, s + w, np.ones(len(g), np.int64)))}
    want = set()
    for k in set(g.tolist()):
        spans = []
        for a, b in sorted((int(x), int(x + y)) for q, x, y in rows if q == k):
            if spans and a <= spans[-1][1]:
                spans[-1] = [spans[-1][0], max(b, spans[-1][1]), spans[-1][2] or a < spans[-1][1]]
            else:
                spans.append([a, b, False])
        want |= {(k, *x) for x in map(tuple, spans)}
    assert got == want


def test_orphans(spark):
    t = T0 + timedelta(days=40)
    nodes = spark.createDataFrame([("N1", T0), ("n1 ", t), ("n2", t), (None, T0), (" ", T0), ("n3", None)], "node_id string, ingestion_date timestamp_ntz")
    versions = spark.createDataFrame([("n9",), (" N9",), (None,)], "node_id string")
    at = T0 + timedelta(days=5)
    edges = spark.createDataFrame(
        [("e1", " n1", "n2", at), ("e1", " n1", "n2", at), ("e2", "N9 ", "zz", None), ("e3", None, "  ", at), ("e4", "entity:x", "n3", at), ("e5", "n2", "n2", None)],
        "edge_id string, source_node_id string, target_node_id string, discovered_at timestamp_ntz",
    )
    meta = spark.createDataFrame([("m1", "gone", at), ("m2", None, at)], "node_id string, superseded_by string, updated_at timestamp_ntz")
    got = {tuple(r) for r in orphan_references(nodes, versions, edges, meta).collect()}
    e = "apex_causal_edges"
    assert got == {
        (e, "target_node_id", "e1", "late", "2024-01"), (e, "source_node_id", "e2", "deleted", "unknown"), (e, "target_node_id", "e2", "missing", "unknown"),
        ("apex_temporal_metadata", "superseded_by", "m1", "missing", "2024-01"),
    }
    assert orphan_references(nodes, versions, edges.limit(0), meta.limit(0)).count() == 0
    assert orphan_references(nodes.limit(0), versions, edges, meta).filter("reason = 'late'").count() == 0


def test_bloom_filter_never_errs(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) k")
    blocks = filter_size(5000)
    out = probe(spark.range(20000).selectExpr("cast(id as string) k"), "k", bloom_blocks(keys, "k", blocks), blocks, "maybe")
    assert out.filter("not maybe and cast(k as long) < 5000").count() == 0
    assert out.filter("maybe and cast(k as long) >= 5000").count() < 300
    large = probe(spark.range(20000).selectExpr("cast(id as string) k"), "k", bloom_blocks(keys, "k", 1 << 19), 1 << 19, "maybe")
    assert large.filter("not maybe and cast(k as long) < 5000").count() == 0 and large.count() == 20000
    assert filter_size(10**9) * 40 >= 10**9


def plain_tree(parent):
    out, path = {}, {}
    for n in parent:
        seen, x = [n], parent[n]
        while x is not None and x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is not None and x in parent:
            out[n] = ("cycle", -1)
        else:
            out[n] = (seen[-1], len(seen) - 1)
            path[n] = seen[::-1]
    return out, path


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cycles"])
def test_hierarchy(spark, kind):
    r = random.Random(kind)
    n = 26
    parent = {
        "random": {str(i): None if i == 0 or r.random() < 0.05 else str(r.randrange(i)) for i in range(n)},
        "chain": {str(i): str(i - 1) if i else None for i in range(n)},
        "star": {str(i): "0" if i else "nowhere" for i in range(n)},
        "cycles": {str(i): str(r.randrange(n)) if i > 3 else None for i in range(n)} | {"x": "x", "y": "z", "z": "y", "w": "x"},
    }[kind]
    df = spark.createDataFrame([(k, k, p) for k, p in parent.items()], "key string, name string, parent string")
    rows = hierarchy(df, with_paths=True)
    want, path = plain_tree(parent)
    below = {k: sum(k in p[:-1] for p in path.values()) for k in path}
    got = rows.collect()
    assert len(got) == len(parent)
    for x in got:
        assert (x.root_id, x.level_no) == want[x.node_id]
        assert x.n_desc == below.get(x.node_id, -1)
        assert x.path == path.get(x.node_id)
    if kind == "random":
        pairs = {(x.ancestor_id, x.node_id, x.distance) for x in descendants(rows).collect()}
        assert pairs == {(a, k, len(p) - 1 - i) for k, p in path.items() for i, a in enumerate(p[:-1])}


def test_nodes_of_a_hierarchy(spark):
    rows = [("A", None, T0, 1), ("a", "b", T0 + timedelta(1), 2), ("b", "  ", T0, 3), (None, "b", T0, 4), ("c", " B ", None, 5), ("c", " B ", None, 5)]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, ingestion_date timestamp_ntz, `name` int")
    assert {tuple(r) for r in node_hierarchy(df).collect()} == {("a", "b", 1, 0), ("b", "b", 0, 2), ("c", "b", 1, 0)}
    assert node_hierarchy(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    low = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}
    for _ in range(200):
        for a, b in edges:
            if a in low and b in low and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == low
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
