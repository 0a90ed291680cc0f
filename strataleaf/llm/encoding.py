"""Encoding of a corpus with a public byte-level BPE, in overlapping chunks."""

from __future__ import annotations

import ast
import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.ranges import byte_ranges, decoded
from strataleaf.session import materialise

TOKENIZERS = "/opt/tokenizers"
#: Bytes of a chunk and of its overlap with the next; characters at a cut whose pre-tokens may be others in the text.
CHUNK, OVERLAP, MARGIN = 1 << 12, 1 << 9, 8


@lru_cache(maxsize=4)
def _pattern(folder: str) -> str:
    lines = (Path(folder) / "__init__.py").read_text().splitlines()
    return ast.literal_eval(next(x for x in lines if x.startswith("PATTERN")).partition("=")[2].strip())


@lru_cache(maxsize=4)
def encoder(folder: str, name: str):
    """The tokenizer, made once a worker process."""
    import tiktoken

    with (Path(folder) / f"{name}.tiktoken").open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=_pattern(folder), mergeable_ranks=ranks, special_tokens={})


def _encode_batches(batches: Iterator[pa.RecordBatch], folder: str, name: str) -> Iterator[pa.RecordBatch]:
    """The last column is a text's bytes; ids take its place."""
    enc = encoder(folder, name)
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        ids = [enc.encode_to_numpy(t.decode("utf-8", "replace"), disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts]
        ends = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=ends[1:])
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*b.schema.names[:-1], "ids"]
        )


_CHUNK = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()), ("at", pa.int64()), ("own", pa.int64()), ("ended", pa.bool_()), ("raw", pa.binary()),
     ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]
)
_CHUNK_DDL = "row long, doc_id long, no int, at long, own long, ended boolean, raw binary, head array<long>, tail array<long>"


def _chunk(pat, row: int, doc: int | None, no: int, at: int, own: bytes, halo: bytes, ended: bool, last: bool, overlap: int) -> dict:
    """A chunk from its place ``at``: its own bytes and the overlap, with the pre-token ends (places in the text)
    that it sees in its first bytes and in the overlap. Pre-tokens are those of a run from the chunk's start.

    Ends after white space are left out: the pattern looks one character past white space, so a piece that ended
    there would be split otherwise than within its text. So are the last places of a cut text, where what follows decides."""
    text = (own + halo).decode("utf-8", "replace")
    ends = [e for m in pat.finditer(text) if not text[(e := m.end()) - 1].isspace()]
    if not ended:
        ends = [e for e in ends if e <= len(text) - MARGIN]
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    place = at + np.concatenate([[0], np.cumsum(width)])[ends] if ends else np.empty(0, np.int64)
    return {
        "row": row, "doc_id": doc, "no": no, "at": at, "own": len(own), "ended": ended, "raw": own + halo,
        "head": place[place < at + overlap].tolist(), "tail": [] if last else place[place >= at + len(own)].tolist(),
    }


def _chunks(batches: Iterator[pa.RecordBatch], folder: str, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    import regex

    pat = regex.compile(_pattern(folder))
    for b in batches:
        rows = []
        for row, doc, no, n, ended, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            _, own, halo, at = decoded(raw, no, size)
            rows.append(_chunk(pat, row, doc, no, at, own.encode(), halo.encode(), ended, no == n - 1, overlap))
        yield pa.RecordBatch.from_pylist(rows, _CHUNK)


def _joined(batches: Iterator[pa.RecordBatch], folder: str, overlap: int) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, parts): neighbours that share no end, as one chunk."""
    import regex

    pat = regex.compile(_pattern(folder))
    for b in batches:
        for row, doc, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own, last = b"".join(p["raw"][: p["own"]] for p in parts), parts[-1]
            halo = last["raw"][last["own"] :]
            yield pa.RecordBatch.from_pylist([_chunk(pat, row, doc, parts[0]["no"], parts[0]["at"], own, halo, last["ended"], not halo, overlap)], _CHUNK)


def _stitched(parts: DataFrame) -> DataFrame:
    """``parts`` with ``from``, where the piece that begins in a chunk begins: the first end that it and the chunk
    before both see in their overlap. Null if there is none."""
    order = Window.partitionBy("row").orderBy("no")
    shared = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    return parts.withColumn("from", F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(shared))


def encode_corpus(
    docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, ids) of each row of (doc_id, text), without special tokens and with the text unchanged.

    A null and an empty text give an empty list; a repeated row gives a row each; null doc_ids stay; an empty
    table gives no rows. Only doc_id and text are read, so other columns may have any name.

    Each text is cut into chunks of ``chunk`` bytes that overlap by ``overlap``. Chunks are pre-tokenised in
    parallel, each from its own start. The pattern never looks back, so two runs that share a pre-token end agree
    from there on: neighbours are stitched at the first end that both see in their overlap, and the pieces between
    stitches are encoded in parallel. Neighbours that share none (in a run of letters or of white space longer than the
    overlap) become one chunk, which is pre-tokenised again and stitched with its neighbours, until all are: a task never
    holds more than such a run, which is one pre-token, and the chunks it touches. A text of one chunk has nothing to be
    stitched and is encoded where it is read. Decoding is concatenation of bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run = lambda df, schema: df.mapInArrow(lambda it: _encode_batches(it, folder, name), schema)
    cut = byte_ranges(docs, "text", chunk, overlap)
    whole = run(cut.filter("n_ranges = 1").select("doc_id", "raw"), "doc_id long, ids array<int>")
    several = docs.filter(F.octet_length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = byte_ranges(several, "text", chunk, overlap).select("row", "doc_id", "no", "n_ranges", "ended", "raw")
    parts = _stitched(materialise(parts.mapInArrow(lambda it: _chunks(it, folder, chunk, overlap), _CHUNK_DDL), "chunks"))
    while not parts.filter(F.col("from").isNull()).isEmpty():
        order = Window.partitionBy("row").orderBy("no")
        named = parts.withColumn("island", F.count("from").over(order))
        named = named.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("row", "island")))
        lone = named.filter("members = 1").select(*_CHUNK.names)
        tied = named.filter("members > 1").groupBy("row", "doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("no", "at", "own", "ended", "raw"))).alias("parts"))
        tied = tied.select("row", "doc_id", "parts").mapInArrow(lambda it: _joined(it, folder, overlap), _CHUNK_DDL)
        parts = _stitched(materialise(lone.unionByName(tied), "chunks"))
    to = F.coalesce(F.lead("from").over(Window.partitionBy("row").orderBy("no")), F.col("at") + F.length("raw"))
    piece = F.substring("raw", (F.col("from") - F.col("at") + 1).cast("int"), (to - F.col("from")).cast("int"))
    pieces = parts.select("row", "doc_id", "no", piece.alias("raw"))
    done = run(pieces, "row long, doc_id long, no int, ids array<int>")
    rows = done.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("p"))
    return whole.unionByName(rows.select("doc_id", F.flatten("p.ids").alias("ids")))


def decode(ids: list[int], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> str:
    """The text of a list of ids: the bytes of all ids, concatenated."""
    return encoder(folder, name).decode_bytes(ids).decode("utf-8")
