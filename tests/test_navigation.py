"""Ranking, walks, vectors and coverage on small fixtures, against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataleaf.functions.embed import embedded_texts, fingerprints
from strataleaf.operators import navigation as N
from strataleaf.operators.extract import fingerprint
from strataleaf.operators.search import nearest
from strataleaf.operators.slices import numbered


def test_walk(spark):
    nodes = [
        ("r", None, 0.0, False), ("a", "r", 9.0, False), ("b", "r", 5.0, False), ("c", "r", 4.0, True),  # c is third: never tried
        ("a1", "a", 3.0, False), ("a2", "a", 2.0, False), ("b1", "b", 1.0, True), ("b2", "b", 1.0, True), ("lone", None, 0.0, True), ("bad", "gone", 0.0, False), (None, "r", 99.0, True),
    ]
    df = spark.createDataFrame([(*x, 1) for x in nodes], "key string, parent string, score double, verified boolean, `path` int")
    assert {tuple(x) for x in N.walk(df).collect()} == {("r", "b1", 2), ("lone", "lone", 0)}
    assert {tuple(x) for x in N.walk(df, back=1).collect()} == {("lone", "lone", 0)}
    assert N.walk(df.limit(0)).count() == 0


def test_numbered(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "x", None]), r.choice(["", "a", "ab", "abc", "b"]) + str(i)) for i in range(80)] + [("x", None)]
    got = numbered(spark.createDataFrame(rows, "k string, t string"), "k", "t", 2).collect()
    for k in {x.k for x in got}:
        own = sorted((x for x in got if x.k == k), key=lambda x: x.position)
        assert [x.position for x in own] == list(range(1, len(own) + 1))
        assert [x.t or "" for x in own] == sorted(x.t or "" for x in own)
    assert len(got) == len(rows)


def test_nearest(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4).round(1)], i % 3) for i in range(60)] + [(60, None, 0), (61, [], 1), (62, [0.0] * 4, 2), (63, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int").repartition(5)
    q = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))

    def cos(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)

    for same, by, least in ((True, None, None), (False, None, 0.2), (True, "label", None)):
        got = {(x[0], x[1]): (x[2], x[3]) for x in nearest(df, q, "vec_id", "v", 5, least, same, by).collect()}
        want = {}
        for i, v, _ in rows:
            if i % 20 == 0:
                best = {}
                for j, w, label in rows:
                    s = cos(v, w)
                    if (same or i != j) and (least is None or s >= least):
                        g = label if by else j
                        best[g] = max(best.get(g, -9.0), s)
                for k, (g, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1):
                    want[i, g] = (s, k)
        assert got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 2e-6 for x in want)
    assert nearest(df, q.limit(0), "vec_id", "v", 5).count() == 0
    assert nearest(df.limit(0), q, "vec_id", "v", 5).count() == 0


def test_embedding_in_batches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "", None, "two"] * 20)], "id long, t string").coalesce(1)
    sizes = {len(x.v) for x in embedded_texts(df, "id", "t", lambda ts: [[float(len(ts))]] * len(ts) if len(ts) == 16 else [], 16).collect()}
    assert sizes == {1} and {len(x.v) for x in embedded_texts(df, "id", "t", lambda ts: 1 / 0).collect()} == {384}
    native = df.filter("t is not null").select("id", fingerprint(F.col("t")).alias("v")).collect()
    assert {x.id: x.v for x in native} == dict(zip([x.id for x in native], fingerprints(["one", "", "two"] * 20), strict=True))


def test_coverage(spark):
    x = N.simulated_coverage(spark, [k / 100 for k in range(1, 101)]).first()
    assert x.empirical_coverage == 1.0 and x.passed and x.n_test == 500 and 3 <= x.avg_prediction_set_size <= 8
    y = N.simulated_coverage(spark, [0.1] * 20).first()
    assert not y.passed and 0.15 < y.empirical_coverage < 0.35  # the true packet is below 0.1 in a quarter of the tests
    assert N.simulated_coverage(spark, [0.9] * 5).first().empirical_coverage == 0.0
