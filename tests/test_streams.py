"""Stateful streams against a plain simulation."""

import random
from collections import defaultdict, deque

import pandas as pd

from strataleaf.streaming import jobs as J


class State:
    """What the functions use of a group's state."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value


def requests(seed, n=300):
    r = random.Random(seed)
    return pd.DataFrame({"id": range(n), "key": [r.randrange(3) for _ in range(n)], "us": sorted(r.randrange(900) * 1_000_000 for _ in range(n)), "entry": [r.choice("abcd") for _ in range(n)]})


def in_batches(rows, run, size):
    """Each key's rows in micro-batches through ``run``."""
    out = []
    for key, own in rows.groupby("key"):
        state = State()
        for at in range(0, len(own), size):
            out.append(pd.concat(run((key,), iter([own.iloc[at : at + size]]), state)))
    return pd.concat(out).set_index("id").sort_index()


def test_rate_limit():
    rows = requests(1)
    got = in_batches(rows, J.limiter(3, 60.0), 7)["allowed"]
    seen = defaultdict(deque)
    for x in rows.itertuples():
        own = seen[x.key]
        while own and x.us - own[0] >= 60_000_000:
            own.popleft()
        assert got[x.id] == (len(own) < 3)
        if len(own) < 3:
            own.append(x.us)


def test_cache():
    rows = requests(2)
    for most in (None, 2):
        got = in_batches(rows, J.ttl_cache(50_000_000, most), 11)["hit"]
        caches = defaultdict(dict)
        for x in rows.itertuples():
            own = caches[x.key]
            was = own.pop(x.entry, None)
            hit = was is not None and x.us - was < 50_000_000
            assert got[x.id] == hit
            own[x.entry] = was if hit else x.us
            if most and len(own) > most:
                del own[next(iter(own))]


def test_rate_limited_query(spark, tmp_path):
    rows = requests(3, 60)
    spark.createDataFrame(rows[["id", "key", "us"]]).coalesce(1).write.parquet(str(tmp_path / "r.parquet"))
    got = {x.id: x.allowed for x in J.run_available(J.rate_limited(J.read(spark, str(tmp_path / "r.parquet")), 2, 100.0), "limit").collect()}
    assert got == in_batches(rows, J.limiter(2, 100.0), 1000)["allowed"].to_dict()
