"""Each row whose id is divisible by 50 is a query."""

import math
import random

from strataleaf.plans import registry


def test_every_query_has_its_answer(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 8) for i in range(160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)), 6)
    near, labels = set(), set()
    for q in (0, 50, 100, 150):
        s = sorted((-cosine(rows_of[q], v), i, label) for rows_of in [{i: v for i, v, _ in rows}] for i, v, label in rows)
        near |= {(q, i, n) for n, (c, i, _) in enumerate(s[:5], 1) if -c >= 0.3}
        best = {}
        for c, _, label in s:
            best.setdefault(label, c)
        labels |= {(q, label, n) for n, (c, label) in enumerate(sorted((c, label) for label, c in best.items())[:5], 1)}
    got = lambda name, key: {(x["qid"], x[key], x["position"]) for x in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(near) == 20 and got("srt06_vector_searches", "vec_id") == near
    assert got("srt07_documents_by_vectors", "label") == labels
