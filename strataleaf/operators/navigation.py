"""Finding answers in document trees: hybrid ranking, candidates over all documents, walks with a budget, and coverage."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.operators.search import cosine, postings, tokens, top_k
from strataleaf.operators.slices import numbered
from strataleaf.plans.pipeline import navigate
from strataleaf.session import materialise

# Weights of vector, words and place; a walk's limits; what a title word and a word in the text count.
WEIGHTS, MAX_DEPTH, MAX_BACK, MAX_CANDIDATES, TITLE, BODY = (0.4, 0.3, 0.3), 10, 15, 5, 3.0, 0.5


def hybrid_scores(leaves: DataFrame, doc: str, key: str, query: str, vector: list[float], weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(key, doc, score) of leaves (doc, key, content, embedding): the weighted sum of the cosine to ``vector`` (0 where lengths differ), of
    query words in the first line and uses in the text, and of the place in the document, each over its greatest there.
    Greatest values are built map-side and places by slices of the key, so a document with a third of all leaves is no single task."""
    low = F.lower("content")
    words = query.lower().split()
    uses = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    title = F.split_part(low, F.lit("\n"), F.lit(1))
    ks = sum((F.when(F.contains(title, F.lit(w)), TITLE).otherwise(0.0) + BODY * uses(w) for w in words), F.lit(0.0))
    vs = F.when(F.size("embedding") == len(vector), cosine(F.col("embedding"), F.array(*map(F.lit, vector)))).otherwise(0.0)
    rows = numbered(leaves.select(doc, key, vs.alias("vs"), ks.alias("ks")), doc, key)
    total = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("__n"), F.max("vs").alias("mv"), F.max("ks").alias("mk"))
    rows = rows.join(total, rows[doc].eqNullSafe(total[doc])).drop(total[doc])
    over = lambda c, m: F.when(F.col(m) != 0, F.col(c) / F.col(m)).otherwise(F.col(c))
    ss = 1.0 - (F.col("position") - 1) / F.col("__n")
    return rows.select(doc, key, (weights[0] * over("vs", "mv") + weights[1] * over("ks", "mk") + weights[2] * ss).alias("score"))


def candidates(questions: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, doc_id, position): first the document whose first line shares most words with the question (tie: the least id), which
    stands for the choice of a completer, then the ``k`` that :func:`navigate` finds, each once."""
    asked = questions.select("item_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    titles = docs.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    shared = asked.join(postings(titles, "doc_id", "title").select("term", "doc_id"), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    chosen = top_k(shared, ["item_id"], 1, F.desc("c"), F.col("doc_id")).select("item_id", "doc_id", F.lit(0).cast("long").alias("place"))
    found = navigate(questions, docs, k).select("item_id", "doc_id", F.col("position").alias("place"))
    one = chosen.unionByName(found).groupBy("item_id", "doc_id").agg(F.min("place").alias("place"))
    return top_k(one, ["item_id"], k + 1, F.col("place"))


def walk(nodes: DataFrame, depth: int = MAX_DEPTH, back: int = MAX_BACK, tries: int = 2) -> DataFrame:
    """(root_id, node_id, n_back) of nodes (key, parent, score, verified): the leaf that a walk from each root ends at.

    At each node the ``tries`` best children with a score above 0 are gone to in turn; a leaf that isn't verified and a node without such
    children are dead ends. The walk ends at the first verified leaf, ``depth`` levels down at most, after at most ``back`` dead
    ends; roots from which none is found have no row. All walks go on level by level as one frontier, of at most
    ``tries`` to the power ``depth`` nodes a root; the order of a walk is that of the nodes' paths."""
    n = nodes.filter("key is not null")
    kids = top_k(n.filter("parent is not null and score > 0"), ["parent"], tries, F.desc("score"), F.col("key"))
    kids = materialise(kids.select("parent", "key", "verified", F.col("position").cast("string").alias("turn")), "children")
    inner = materialise(n.select(F.col("parent").alias("key")).filter("key is not null").distinct(), "inner")
    able = kids.select(F.col("parent").alias("key")).distinct()
    known = n.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    roots = n.join(known, "parent", "left").filter("known is null").select(F.col("key").alias("root_id"), "key", "verified", F.lit("").alias("path"))
    frontier, ends = materialise(roots, "frontier"), []
    for level in range(depth + 1):
        leaf = frontier.join(inner.withColumn("inner", F.lit(True)), "key", "left").join(able.withColumn("able", F.lit(True)), "key", "left")
        hit = F.col("inner").isNull() & F.coalesce("verified", F.lit(False))
        ends.append(materialise(leaf.filter("inner is null or able is null").select("root_id", "key", "path", hit.alias("hit")), "ends"))
        if level == depth:
            break
        down = frontier.select("root_id", F.col("key").alias("parent"), "path").join(kids, "parent")
        frontier = materialise(down.select("root_id", "key", "verified", F.concat("path", "turn").alias("path")), "frontier")
        if frontier.isEmpty():
            break
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    first = every.filter("hit").groupBy("root_id").agg(F.min(F.struct("path", "key")).alias("f"))
    j = every.join(first, "root_id").groupBy("root_id").agg(F.first("f.key").alias("node_id"), F.count_if(F.col("path") < F.col("f.path")).alias("n_back"))
    return j.filter(F.col("n_back") <= back)


def integrated(questions: DataFrame, docs: DataFrame, word: str, k: int = 5, level: float = 0.6, least: int = 3) -> DataFrame:
    """(item_id, n_kept, n_found, doc_id, answer): what is found for a question, with its nonconformity (score below the best, the
    ``word`` missing, place), kept up to the threshold calibrated on the same packets; fewer than ``least`` are all kept."""
    from strataleaf.operators.stats import nonconformity

    found = navigate(questions, docs, k).join(docs.select("doc_id", "text"), "doc_id")
    best = found.groupBy("item_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    p = found.join(best, "item_id")
    verified = F.contains(F.lower("text"), F.lit(word))
    p = p.withColumn("nc", F.round(nonconformity("ensemble", F.col("score") / F.col("best"), verified, F.col("position"), F.lit(k)), 6))
    # a question has at most k packets
    place = F.greatest(F.least(F.ceil((F.col("n") + 1) * F.lit(1.0 - (1.0 - level))), F.col("n")), F.lit(1)).cast("int")
    t = p.groupBy("item_id").agg(F.array_sort(F.collect_list("nc")).alias("s"), F.first("n").alias("n"))
    t = t.select("item_id", F.when(F.col("n") < least, 1.0).otherwise(F.element_at("s", place)).alias("t"))
    p = p.join(t, "item_id").withColumn("kept", F.col("nc") <= F.col("t"))
    first = lambda c: F.min_by(c, F.when(F.col("kept"), F.col("position")))
    return p.groupBy("item_id").agg(
        F.count_if("kept").alias("n_kept"), F.count(F.lit(1)).alias("n_found"), first("doc_id").alias("doc_id"), F.substring(first("text"), 1, 120).alias("answer")
    )


def simulated_coverage(spark: SparkSession, calibration: list[float], level: float = 0.9, tolerance: float = 0.02, n_test: int = 500, seed: int = 42) -> DataFrame:
    """One row (empirical_coverage, claimed, passed, n_test, avg_prediction_set_size) of a seeded simulation: each test has 3 to 8 packets with
    scores in [0, 1), one of them, the true one, in [0, 0.4), and is covered if that is at most the calibrated threshold."""
    import math

    rng, s = random.Random(seed), sorted(calibration)
    t = s[max(min(math.ceil((len(s) + 1) * (1.0 - (1.0 - level))), len(s)), 1) - 1] if len(s) >= 10 else 0.0
    covered = kept = 0
    for _ in range(n_test):
        n = rng.randint(3, 8)
        true = rng.randint(0, n - 1)
        scores = [rng.uniform(0.0, 0.4 if i == true else 1.0) for i in range(n)]
        covered += scores[true] <= t
        kept += sum(x <= t for x in scores)
    share = covered / n_test
    row = [(round(share, 4), level, share >= level - tolerance, n_test, round(kept / n_test, 2))]
    return spark.createDataFrame(row, "empirical_coverage double, claimed double, passed boolean, n_test int, avg_prediction_set_size double")

