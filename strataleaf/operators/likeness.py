"""Pairs of a document's nodes with like embeddings, wherever they stand in its tree.

Each document's nodes are cut into blocks by the hash of their ids and each two blocks are compared by one task, every
pair with the exact cosine; a document with a tenth of all rows is so spread over many tasks, each of bounded memory.
All pairs of a document are compared: the time grows with the square of a document's nodes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.ids import norm_id
from strataleaf.operators.components import _forest, components
from strataleaf.operators.extract import negated
from strataleaf.operators.hierarchy import latest_nodes
from strataleaf.session import materialise

# Fixed value: about so many nodes a block, so a task holds a few matrices of its square.
BLOCK = 1024


def embedded(nodes: DataFrame) -> DataFrame:
    """The nodes that have an embedding of some length, with what the comparisons need. same tells contents apart but for
    case and blanks around them."""
    n = latest_nodes(nodes, "doc_id", "parent_id", "embedding", "content", "source_date")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    low = F.lower(F.coalesce("content", F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\b([a-z]{4,})\b"), F.lit(1)))
    rows = n.filter((F.size("embedding") == 4) & (size > 0)).select(
        F.col("doc_id").alias("doc"), F.col("key").alias("id"), F.xxhash64("key").alias("h"), norm_id("parent_id").alias("parent"), F.col("embedding").alias("v"),
        F.xxhash64(F.regexp_replace(low, r"(?U)^\s+|\s+$", "")).alias("same"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
        negated(F.col("content")).alias("neg"), F.unix_micros(F.col("source_date").cast("timestamp")).alias("dated"),
    )
    return materialise(rows, "embedded")


def _by_blocks(rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(a, b, upper)`` on each two blocks of a document, those of a block with itself included."""
    n = rows.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    r = rows.join(n, "doc").withColumn("part", F.pmod("h", "blocks"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    r = r.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        a = t.filter(pc.equal(t["part"], i))
        b = a if i == j else t.filter(pc.equal(t["part"], j))
        return kernel(a, b, i == j)

    return r.groupBy("doc", "i", "j").applyInArrow(run, schema)


def _vectors(t: pa.Table) -> np.ndarray:
    return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)


def _cosines(a: pa.Table, b: pa.Table) -> np.ndarray:
    x, y = _vectors(a), _vectors(b)
    dot = sum(x[:, None, k] * y[None, :, k] for k in range(4))
    norm = lambda m: np.sqrt(sum(m[:, k] * m[:, k] for k in range(4)))
    return dot / (norm(x)[:, None] * norm(y)[None, :])


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers that are equal where the values are; -1 for null."""
    code: dict = {None: -1}
    return [np.array([code.setdefault(x, len(code)) for x in c.to_pylist()]) for c in columns]


def _links(a: pa.Table, b: pa.Table, upper: bool, least: float, closed: bool, apart: bool) -> np.ndarray:
    cos = _cosines(a, b)
    hit = cos >= least if closed else cos > least
    if apart:  # neither parent and child nor children of one node
        ai, ap, bi, bp = _codes(a["id"], a["parent"], b["id"], b["parent"])
        hit &= ~((ap[:, None] == bi) | (ai[:, None] == bp) | ((ap[:, None] == bp) & (ap[:, None] >= 0)))
    return np.triu(hit, 1) if upper else hit


def like_nodes(rows: DataFrame, least: float, closed: bool = False, apart: bool = False, texts_differ: bool = False) -> DataFrame:
    """(node_id, class_id, n_links) of each embedded node: its single-linkage class over the pairs above ``least`` (or at it,
    if ``closed``), named by its smallest member, and with how many nodes it is linked. ``apart``: without links between
    parent and child or siblings. ``texts_differ``: n_links leaves out nodes of the same text, the classes don't."""

    def kernel(a: pa.Table, b: pa.Table, upper: bool) -> pa.Table:
        hit = _links(a, b, upper, least, closed, apart)
        ha, hb = a["h"].to_numpy(), b["h"].to_numpy()
        x, y = np.nonzero(hit)
        if texts_differ:
            hit &= a["same"].to_numpy()[:, None] != b["same"].to_numpy()
        nodes, n = np.concatenate([ha, hb]), np.concatenate([hit.sum(1), hit.sum(0)]).astype(np.int64)
        stars = list(_forest(iter([pa.RecordBatch.from_arrays([pa.array(ha[x]), pa.array(hb[y])], names=["u", "v"])]))) if len(x) else []
        u = np.concatenate([s.column(0).to_numpy() for s in stars]) if stars else np.empty(0, np.int64)
        v = np.concatenate([s.column(1).to_numpy() for s in stars]) if stars else np.empty(0, np.int64)
        return pa.table({
            "u": pa.array(np.concatenate([u, nodes])), "v": pa.array([*v.tolist(), *[None] * len(nodes)], pa.int64()),
            "n": pa.array([*[None] * len(u), *n.tolist()], pa.int64()),
        })

    found = materialise(_by_blocks(rows.select("doc", "id", "h", "parent", "v", "same"), kernel, "u long, v long, n long"), "likeness")
    n = found.filter("n is not null").groupBy(F.col("u").alias("h")).agg(F.sum("n").alias("n_links"))
    c = components(found.filter("v is not null").select("u", "v")).select(F.col("node").alias("h"), "component")
    out = rows.select("h", "id").join(n, "h", "left").join(c, "h", "left").withColumn("component", F.coalesce("component", "h"))
    names = out.groupBy("component").agg(F.min("id").alias("class_id"))
    return out.join(names, "component").select(F.col("id").alias("node_id"), "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def contradicting(rows: DataFrame, least: float = 0.65) -> DataFrame:
    """(x, y), x < y: pairs above ``least`` whose texts differ, share a word of four letters or more, and of which one denies
    something; x_dated and y_dated are their dates."""

    def kernel(a: pa.Table, b: pa.Table, upper: bool) -> pa.Table:
        hit = _links(a, b, upper, least, False, False)
        hit &= a["same"].to_numpy()[:, None] != b["same"].to_numpy()
        no = [t["neg"].to_numpy(zero_copy_only=False).astype(bool) for t in (a, b)]
        hit &= no[0][:, None] | no[1]
        hit &= _shared(a["words"], b["words"], hit)
        x, y = np.nonzero(hit)
        swap = np.array(pc.greater(ia := a["id"].take(pa.array(x)), ib := b["id"].take(pa.array(y))).to_pylist(), bool)
        da, db = a["dated"].take(pa.array(x)), b["dated"].take(pa.array(y))
        pick = lambda p, q: pc.if_else(pa.array(swap, pa.bool_()), q, p)
        return pa.table({"x": pick(ia, ib), "y": pick(ib, ia), "x_dated": pick(da, db), "y_dated": pick(db, da)})

    return _by_blocks(rows.select("doc", "id", "h", "parent", "v", "same", "words", "neg", "dated"), kernel, "x string, y string, x_dated long, y_dated long")


def _shared(a: pa.ChunkedArray, b: pa.ChunkedArray, where: np.ndarray) -> np.ndarray:
    """Whether two lists have a value in common, looked at for the rows and columns of ``where`` that hold a hit."""
    out = np.zeros(where.shape, bool)
    rows, cols = np.flatnonzero(where.any(1)), np.flatnonzero(where.any(0))
    wa, wb = [a[int(i)].as_py() for i in rows], [b[int(i)].as_py() for i in cols]
    both = sorted({w for x in wa for w in x} & {w for x in wb for w in x})
    place = {w: k for k, w in enumerate(both)}
    for at in range(0, len(both), 512):
        ma, mb = (np.zeros((len(ws), 512), np.float32) for ws in (wa, wb))
        for m, ws in ((ma, wa), (mb, wb)):
            for r, x in enumerate(ws):
                for w in x:
                    if at <= place.get(w, -1) < at + 512:
                        m[r, place[w] - at] = 1
        out[np.ix_(rows, cols)] |= ma @ mb.T > 0
    return out
