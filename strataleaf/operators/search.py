"""Lexical and vector ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that are sent to all tasks at once.
QUERY_BLOCK = 4096

# Stop words of the two tokenisers.
STOP_SHORT = ["the", "is", "in", "and", "to", "a", "of", "for", "on", "with", "as", "by"]
STOP_LONG = [*STOP_SHORT, "an", "at", "it", "this"]


def tokens(text: Column, least: int = 1, stop: list[str] | None = None) -> Column:
    """ASCII words of at least ``least`` characters, lower-cased, without stop words; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[a-z0-9_]{{{least},}}"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*(STOP_SHORT if stop is None else stop)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, a vector is null or empty, or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def normalised(vectors: DataFrame, column: str) -> DataFrame:
    """Vectors of length 1; those without length are dropped, as nothing is near them."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return vectors.withColumn("__n", norm).filter("__n > 0").withColumn(column, F.transform(column, lambda v: v.cast("double") / F.col("__n"))).drop("__n")


def top_k(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows per key. The window's limit is pushed below the shuffle, so each task sends k rows a key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("position") <= k)


def structural_score(query: str, content: Column, is_heading: Column, least: int = 3) -> Column:
    """+50 if the phrase stands in the text, +15 a query word in a heading, +5 a shared word, +10 times the share
    of the text's words that are shared; 0 if either has no words."""
    words = sorted({w for w in _plain(query, least)})
    q, low = F.array(*map(F.lit, words)), F.lower(F.coalesce(content, F.lit("")))
    own = tokens(content, least, STOP_LONG)
    shared = F.size(F.array_intersect(q, own))
    heading = sum((F.when(F.contains(low, F.lit(w)), 15.0).otherwise(0.0) for w in words), F.lit(0.0))
    score = F.when(F.contains(low, F.lit(query.lower())), 50.0).otherwise(0.0) + F.when(is_heading, heading).otherwise(0.0)
    return F.when(F.size(own) > 0, score + shared * 5.0 + shared / F.size(own) * 10.0).otherwise(0.0) if words else F.lit(0.0)


def _plain(query: str, least: int) -> list[str]:
    import re

    return [w for w in re.findall(rf"[a-z0-9_]{{{least},}}", query.lower()) if w not in STOP_LONG]


def term_score(query: str, content: Column, is_heading: Column) -> Column:
    """Occurrences of the query's words over the text's words, five-fold in headings."""
    own = tokens(content)
    words = _plain(query, 1)
    hits = F.size(F.filter(own, lambda x: x.isin(*words))) if words else F.lit(0)
    return F.when(F.size(own) > 0, hits * F.when(is_heading, 5.0).otherwise(1.0) / F.size(own)).otherwise(0.0)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index: (term, key, tf, n_terms)."""
    rows = docs.select(key, tokens(F.col(text)).alias("own"))  # else the words were split again for each of them
    rows = rows.select(key, "own", F.explode("own").alias("term")).select(key, F.size("own").alias("n_terms"), "term")
    return rows.groupBy("term", key, "n_terms").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that hold a query word. Only the query's words are read from the index; counts
    of documents and words are over all documents."""
    words = sorted(set(_plain(query, 1)))
    uses = lambda w: F.size(F.filter("own", lambda x: x == w))
    rows = docs.select(key, tokens(F.col(text)).alias("own")).select(key, F.size("own").alias("n"), *[uses(w).alias(f"t{i}") for i, w in enumerate(words)])
    stats = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    j = rows.crossJoin(F.broadcast(stats))  # one row of totals
    part = lambda i: F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)) * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    score = sum((part(i) for i in range(len(words))), F.lit(0.0))
    return j.filter(F.greatest(F.lit(0), *[F.col(f"t{i}") for i in range(len(words))]) > 0).select(key, score.alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float | None = None, same: bool = True, by: str | None = None) -> DataFrame:
    """(qid, key, score, position): for each query (qid, q) the ``k`` vectors of greatest cosine (rounded to 6 places; ties: the least
    key), with ``by`` the k values of that column by their best vector; only scores of ``least`` or more, and with ``same`` off not the vector
    whose key is the query's id. A vector without length, or of another length than the query, scores 0.

    Queries go in blocks of QUERY_BLOCK to all tasks, which is what bounds that; a task multiplies each batch of vectors with the
    block and keeps the best of each query, so no pairs are shuffled but k a query and batch. More queries are more passes."""
    spark = vectors.sparkSession
    out_key = by or key
    schema = T.StructType([T.StructField("qid", T.LongType()), vectors.schema[out_key], T.StructField("score", T.DoubleType())])

    def unit(rows: list, width: int) -> np.ndarray:
        m = np.array([v if v is not None and len(v) == width else [0.0] * width for v in rows], float).reshape(len(rows), width)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def one(block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = block.value
            width = max(map(len, asked))
            q = unit(asked, width)
            for b in batches:
                keys, groups = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                score = np.round(q @ unit(b.column(1).to_pylist(), width).T, 6) + 0.0
                found: list[tuple] = []
                order = np.argsort(keys, kind="stable")
                for i, qid in enumerate(ids):
                    best = order[np.argsort(-score[i, order], kind="stable")]
                    seen: set = set()
                    for j in best:
                        if len(seen) == k or (least is not None and score[i, j] < least):
                            break
                        if groups[j] not in seen and (same or keys[j] != qid):
                            seen.add(groups[j])
                            found.append((qid, groups[j], float(score[i, j])))
                cols = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(list(cols[1]), b.schema.field(2).type), pa.array(cols[2], pa.float64())], names=schema.names)

        return vectors.select(key, vector, F.col(out_key).alias("__g")).mapInArrow(run, schema)

    parts, ids, asked = [], [], []
    for r in queries.select(F.col("qid").cast("long"), "q").toLocalIterator():
        ids.append(r[0])
        asked.append([float(x) for x in r[1] or ()] or [0.0])
        if len(ids) == QUERY_BLOCK:
            parts.append(one(spark.sparkContext.broadcast((ids, asked))))
            ids, asked = [], []
    if ids or not parts:
        parts.append(one(spark.sparkContext.broadcast((ids, asked or [[0.0]]))))
    best = reduce(DataFrame.unionByName, parts).groupBy("qid", out_key).agg(F.max("score").alias("score"))
    return top_k(best, ["qid"], k, F.desc("score"), F.col(out_key))
