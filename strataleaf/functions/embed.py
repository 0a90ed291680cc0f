"""Texts to vectors by a pluggable encoder, in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: An encoder takes texts and gives as many vectors, or raises; then the batch falls back to fingerprints.
Encoder = Callable[[list[str]], list[list[float]]]
SIZE, BATCH = 384, 16


def fingerprints(texts: list[str]) -> list[list[float]]:
    """Deterministic vectors: eight hex digits at a time of sha256(text:counter), scaled to [-1, 1)."""
    out = []
    for t in texts:
        digits = "".join(hashlib.sha256(f"{t}:{k}".encode()).hexdigest() for k in range(SIZE // 8))
        out.append([int(digits[i : i + 8], 16) / 4294967296.0 * 2 - 1 for i in range(0, len(digits), 8)])
    return out


def embedded_texts(rows: DataFrame, key: str, text: str, encode: Encoder = fingerprints, batch: int = BATCH) -> DataFrame:
    """(key, v): ``encode`` is called with ``batch`` texts at a time, null as empty; a batch that it fails on, or for which it gives
    another number of vectors, gets fingerprints."""
    schema = T.StructType([rows.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, vectors = [t or "" for t in b[text]], []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    got = encode(part)
                except Exception:  # whatever the encoder is
                    got = []
                vectors += got if len(got) == len(part) else fingerprints(part)
            yield pd.DataFrame({key: b[key], "v": vectors})

    return rows.select(key, text).mapInPandas(run, schema)
