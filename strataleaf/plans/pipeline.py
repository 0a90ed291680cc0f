"""Many questions answered at once: retrieval by an inverted index, a threshold, and a pluggable completer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataleaf.operators.search import postings, tokens, top_k

#: A completer takes prompts and gives as many texts. The default is deterministic: the prompt's first 120 characters.
Completer = Callable[[list[str]], list[str]]


def first_characters(prompts: list[str]) -> list[str]:
    return [p[:120] for p in prompts]


def navigate(questions: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, doc_id, score, position) of the ``k`` documents that share most with each question (item_id,
    question): the sum over its distinct words of their share in the document. Words meet in an equi-join with
    the index, where a common word's postings are spread by the runtime skew join; sums are built map-side."""
    asked = questions.select("item_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    index = postings(docs, "doc_id", "text")
    hits = asked.join(index, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("tf") / F.col("n_terms")), 9).alias("score"))
    return top_k(hits, ["item_id"], k, F.desc("score"), F.col("doc_id"))


def completed(rows: DataFrame, prompt: str, out: str, complete: Completer = first_characters) -> DataFrame:
    """``rows`` with column ``out``, what the completer says to column ``prompt``; a batch of rows is one call."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = complete([p if isinstance(p, str) else "" for p in b[prompt]])
            yield b

    return rows.mapInPandas(run, schema)


def answers(questions: DataFrame, docs: DataFrame, k: int = 5, least: float = 0.0, complete: Completer = first_characters) -> DataFrame:
    """(item_id, n_evidence, confidence, answer): the completer's answer over the best document of those that score
    at least ``least``; questions without one have no row."""
    found = navigate(questions, docs, k).filter(F.col("score") >= least)
    best = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.max("score").alias("confidence"), F.min_by("doc_id", "position").alias("doc_id"))
    rows = best.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "n_evidence", "confidence", "text")
    return completed(rows, "text", "answer", complete).drop("text")
