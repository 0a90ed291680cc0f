"""Like nodes of a document against plain Python over all pairs, as the reference compares them."""

import math
import random
import re
from datetime import datetime, timedelta
from itertools import combinations

import pytest

from strataleaf.operators import likeness as L
from strataleaf.operators.extract import NEGATIONS

SCHEMA = "node_id string, content string, parent_id string, doc_id string, source_date timestamp_ntz, ingestion_date timestamp_ntz, embedding array<double>"
T0 = datetime(2024, 1, 1)


def nodes_of(seed, n=70):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        doc = r.choice(["d1", "d1", "d2"])
        parent = r.choice([None, f" N{r.randrange(n)} ", f"n{r.randrange(n)}"])
        v = r.choice([[r.gauss(0, 1) for _ in range(4)]] * 5 + [[], None, [0.0] * 4])
        text = r.choice(["the budget holds", " The budget HOLDS ", "the budget does not hold", "however small", "data 12", "", "plans of budget instead"])
        date = r.choice([None, T0, T0 + timedelta(days=r.randrange(9))])
        rows.append((f"n{i}", text, parent, doc, date, T0 + timedelta(hours=1), v))
        if r.random() < 0.2:  # an older delivery of other values doesn't count
            rows.append((f" N{i}", "not budget", None, doc, T0, T0, [1.0, 1.0, 1.0, 1.0]))
    return rows


def kept(rows):
    best = {}
    for x in rows:
        k = x[0].strip(" ").lower()
        if k not in best or x[5] > best[k][5]:
            best[k] = (k, *x[1:])
    return [x for x in best.values() if x[6] and any(x[6])]


def cosine(a, b):
    return sum(p * q for p, q in zip(a, b, strict=True)) / (math.sqrt(sum(p * p for p in a)) * math.sqrt(sum(p * p for p in b)))


def classes(rows, pairs):
    of = {x[0]: x[0] for x in rows}

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {k: root(k) for k in of}


@pytest.mark.parametrize("block", [1024, 9])
def test_like_nodes(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    raw = nodes_of(1)
    rows = kept(raw)
    e = L.embedded(spark.createDataFrame(raw, SCHEMA))
    up = {x[0]: x[2] and x[2].strip(" ").lower() for x in rows}
    alike = {(a[0], b[0]): (a, b, cosine(a[6], b[6])) for a, b in combinations(rows, 2) if a[3] == b[3]}
    assert sum(c > 0.65 and up[a] != up[b] for (a, b), (*_, c) in alike.items()) > 30  # most have no parent in common
    for least, apart, differ in ((0.65, False, False), (0.65, False, True), (0.75, True, False)):
        near = {k: v for k, v in alike.items() if v[2] > least}
        if apart:
            near = {(a, b): v for (a, b), v in near.items() if up[a] != b and up[b] != a and (up[a] is None or up[a] != up[b])}
        names = classes(rows, near)
        n = dict.fromkeys(names, 0)
        for k, (a, b, _) in near.items():
            if not differ or a[1].strip().lower() != b[1].strip().lower():
                for x in k:
                    n[x] += 1
        got = L.like_nodes(e, least, closed=apart, apart=apart, texts_differ=differ).collect()
        assert sorted(map(tuple, got)) == sorted((k, c, n[k]) for k, c in names.items())


@pytest.mark.parametrize("block", [1024, 9])
def test_contradicting(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    raw = nodes_of(2)
    rows = kept(raw)
    words = lambda t: set(re.findall(r"\b([a-z]{4,})\b", t.lower()))
    no = lambda t: any(re.search(p, t.lower()) for p in NEGATIONS)
    want = set()
    for a, b in combinations(rows, 2):
        if a[3] == b[3] and cosine(a[6], b[6]) > 0.65 and a[1].strip().lower() != b[1].strip().lower() and words(a[1]) & words(b[1]) and (no(a[1]) or no(b[1])):
            want.add((*sorted((a[0], b[0])),))
    got = [(x.x, x.y) for x in L.contradicting(L.embedded(spark.createDataFrame(raw, SCHEMA))).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)
