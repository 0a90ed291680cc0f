"""Greedy filling of chunks with paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greedy_chunks(text: Column, max_chars: int = 3000, joiner: str = "\n\n") -> Column:
    """Paragraphs joined as long as their lengths, joiners not counted, stay within ``max_chars``; a single longer
    paragraph stays whole. Null for null."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(s: Column, p: Column) -> Column:
        full = s["open"].isNotNull() & (s["size"] + F.length(p) > max_chars)
        done = F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"])
        open_ = F.when(full | s["open"].isNull(), p).otherwise(F.concat(s["open"], F.lit(joiner), p))
        return F.struct(done.alias("done"), open_.alias("open"), F.when(full, F.length(p)).otherwise(s["size"] + F.length(p)).alias("size"))

    return F.aggregate(F.split(text, joiner), start, step, lambda s: F.array_append(s["done"], s["open"]))
