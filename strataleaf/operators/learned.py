"""A learned router of questions to projections, trained here on what the word lists say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a router is fitted on, places that words and pairs of words are hashed to, and steps of the fit.
MOST_ROWS, FEATURES, STEPS = 20_000, 1 << 13, 300


def features(text: Column) -> Column:
    """The places of a text's words and pairs of neighbouring words, each once: at most FEATURES."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 2, 1 << 30), words, lambda b, a: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return F.array_distinct(F.transform(F.array_compact(F.concat(words, pairs)), lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int")))


def _rows_of(places: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in places], np.int64)
    flat = np.fromiter((k for x in places for k in x), np.int64, int(size.sum()))
    return np.repeat(np.arange(len(places)), size), flat


def _scores(weights: np.ndarray, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The sum of a row's weights, the last weight being its constant."""
    return np.stack([np.bincount(row, w[place], n) + w[-1] for w in weights])


def fit(rows: DataFrame, labels: list[str], most: int = MOST_ROWS) -> np.ndarray:
    """Weights of a logistic regression for each label of (text, *labels), fitted on at most ``most`` rows, those with the least hash of
    their text; rows with one text count once, null texts not. That bounds what the driver holds. An empty table gives weights of 0."""
    known = rows.filter("text is not null").groupBy("text").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in labels])
    known = known.orderBy(F.xxhash64("text")).limit(most).select(features(F.col("text")).alias("x"), *labels).toArrow()
    n = known.num_rows
    weights = np.zeros((len(labels), FEATURES + 1))
    if not n:
        return weights
    row, place = _rows_of(known["x"].to_pylist())
    wanted = np.stack([known[c].to_numpy() for c in labels])
    past = np.full_like(weights, 1e-8)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(_scores(weights, row, place, n), -30, 30))) - wanted
        slope = np.stack([np.append(np.bincount(place, e[row], FEATURES), e.sum()) for e in error]) / n + 3e-3 * weights
        past += slope * slope
        weights -= 0.5 * slope / np.sqrt(past)
    return weights


def route(weights: np.ndarray, rows: DataFrame, labels: list[str]) -> DataFrame:
    """``rows`` with is_label for each label; a null text needs nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    names = [f"is_{c}" for c in labels]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.BooleanType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, place = _rows_of(b.column(b.num_columns - 1).to_pylist())
            known = b.column("text").is_valid().to_numpy(zero_copy_only=False)
            need = (_scores(shared.value, row, place, b.num_rows) > 0) & known
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, need)], names=[*b.schema.names[:-1], *names])

    return rows.select("*", features(F.col("text")).alias("__x")).mapInArrow(run, schema)
