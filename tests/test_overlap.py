"""Overlapping intervals against all pairs, order statistics against sorting."""

import random
from datetime import datetime, timedelta

from strataleaf.operators import facts as O
from strataleaf.operators.stats import order_stats

T0 = datetime(2024, 1, 1)
KIND = "fact_id string, tenant_id string, doc_id string, subject string, object string, valid_from timestamp_ntz, valid_to timestamp_ntz, created_at timestamp_ntz, parent_fact_id string, superseded_by string, `level` int, `no` int"


def random_facts(seed, n=90):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.choice([None, *[T0 + timedelta(hours=r.randrange(3000))] * 12, datetime(1850, 1, 1), datetime(2400, 1, 1)])
        end = r.choice([None, datetime(9999, 12, 31), *[start and start + timedelta(hours=r.randrange(-5, r.choice([20, 3000])))] * 6])
        rows.append((f"f{i:02}", "t", r.choice(["hot", "hot", "a"]), "s", r.choice("xyz"), start, end, T0 + timedelta(minutes=r.randrange(40)), r.choice([None, f"f{i - 1:02}"]), None, 1, 2))
    return rows


def test_conflicts_and_chains(spark):
    far = datetime(9999, 12, 31)
    for seed in range(3):
        rows = random_facts(seed)
        df = spark.createDataFrame(rows, KIND)
        conflicts, chains = set(), set()
        for a in rows:
            for b in rows:
                if a[2] != b[2] or a[5] is None or b[5] is None:
                    continue
                if (a[7], a[0]) < (b[7], b[0]) and a[5] <= (b[6] or far) and (a[6] or far) > b[5]:
                    conflicts.add((a[0], b[0], "WINDOW_OVERLAP" if a[4] == b[4] else "VALUE_CONFLICT"))
                if (a[5], a[0]) < (b[5], b[0]) and (a[6] is None or a[6] > b[5]) and a[0] != b[8] and b[0] != a[8]:
                    chains.add((a[0], b[0]))
        assert {(x.a_fact_id, x.b_fact_id, x.kind) for x in O.conflicts(df).collect()} == conflicts
        assert {(x.a_fact_id, x.b_fact_id) for x in O.chain_overlaps(df).collect()} == chains
    assert O.conflicts(df.limit(0)).count() == 0


def test_order_statistics(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.random(), r.randrange(5) / 1.0])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v double")
    for x in order_stats(df, ["k"], "v", {"p5": 0.5, "p99": 0.99}).collect():
        own = sorted(v for k, v in rows if k == x.k and v is not None)
        assert (x.n, x.least, x.most, x.p5, x.p99) == (len(own), own[0], own[-1], own[len(own) // 2], own[min(int(len(own) * 0.99), len(own) - 1)])
    assert order_stats(df, [], "v", {"p5": 0.5}).first().n == sum(v is not None for _, v in rows)
    assert order_stats(df.limit(0), ["k"], "v", {"p5": 0.5}).count() == 0
