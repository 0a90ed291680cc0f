"""Long exact spans shared between documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.ranges import LEAD, byte_ranges, decoded
from strataleaf.operators.orphans import bloom_blocks, filter_size, probe
from strataleaf.session import materialise

#: Characters of a stretch that counts; of an anchor (a run of an anchor's length is chosen in each stretch).
MIN_CHARS, ANCHOR = 120, 60
#: Bytes of a text that are looked at as one, and characters that are hashed at once in a Python worker.
RANGE, BATCH_CHARS = 1 << 16, 1 << 19
#: Characters that end a sentence: full stop, marks, line's end, ideographic full stop.
ENDERS = (46, 33, 63, 10, 0x3002)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _of_chars(code: np.ndarray) -> np.ndarray:
    return _mixed(code.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


_CHARS = _of_chars(np.arange(1 << 16))


class Hashed:
    """Polynomial hashes of all runs of some texts' ranges, laid end to end. Runs begin in a range's own characters
    and may end in its halo."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, parts: list[tuple[str, str, str, int]], ended: list[bool]):
        code = [np.frombuffer((own + halo).encode("utf-32-le"), np.uint32) for _, own, halo, _ in parts]
        self.sizes = np.array([len(c) for c in code], np.int64)
        self.own = np.array([len(own) for _, own, _, _ in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.before = [p[0] for p in parts]
        self.first = np.array([p[3] == 0 for p in parts], bool)
        self.ended = np.array(ended, bool)
        n = int(self.sizes.sum())
        up, self.down = self._pow(n + 1)
        self.code = np.concatenate(code) if n else np.empty(0, np.uint32)
        x = _CHARS[np.minimum(self.code, 0xFFFF)] if n else np.empty(0, np.uint64)
        if n and int(self.code.max()) > 0xFFFF:
            high = self.code > 0xFFFF
            x[high] = _of_chars(self.code[high])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * up[:n], out=self.sums[1:])

    @classmethod
    def _pow(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            size = max(n, BATCH_CHARS * 2)
            both = []
            for b in (_BASE, _INVERSE):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            cls._powers = (both[0], both[1])
        return cls._powers

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of [lo, hi), the same wherever the run stands."""
        return _mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))

    def sentence_runs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) of the run of consecutive sentences from each sentence's start, as many as make ``least``
        characters. Where a sentence begins is told by the two characters around the place, or by the text's ends."""
        n = len(self.code)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stop = np.isin(self.code, ENDERS)
        inner = np.ones(n, bool)
        inner[self.starts[self.starts < n]] = False
        at = np.flatnonzero(inner[1:] & stop[:-1] & ~stop[1:]) + 1
        head = self.first | np.array([bool(b) and ord(b) in ENDERS for b in self.before])
        filled = self.sizes > 0
        head[filled] &= self.first[filled] | ~stop[self.starts[filled]]
        begin = np.union1d(at, self.starts[head & filled])
        ends = np.union1d(at, (self.starts + self.sizes)[self.ended])
        doc = self.doc_of(begin)
        begin = begin[begin - self.starts[doc] < self.own[doc]]
        k = np.searchsorted(ends, begin + least)
        begin, k = begin[k < len(ends)], k[k < len(ends)]
        doc = self.doc_of(begin)
        ok = ends[k] <= (self.starts + self.sizes)[doc]
        return begin[ok], ends[k][ok]

    def anchors(self, stretch: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place): each window of ``stretch`` characters within a text, and its anchor: the leftmost of
        its runs of ``anchor`` characters with the least hash. Equal windows have their anchors at equal places."""
        n = len(self.sums) - 1
        if n < stretch:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        m, width = n - anchor + 1, stretch - anchor + 1
        # 40 bits of a hash that need only be well spread, then the place, so the least is the leftmost
        h = (self.sums[anchor:] - self.sums[:m]) * self.down[:m]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        packed = np.full(-(-m // width) * width, np.uint64(2**64 - 1))
        packed[:m] = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
        rows = packed.reshape(-1, width)
        head = np.minimum.accumulate(rows, axis=1).ravel()
        tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - stretch + 1
        least = np.minimum(tail[:m], head[width - 1 : width - 1 + m])
        last = self.starts + np.minimum(self.sizes - stretch, self.own - 1)
        ok = np.flatnonzero(np.arange(m) <= np.repeat(last, self.sizes)[:m])
        return ok, (least[ok] & np.uint64(0xFFFFFF)).astype(np.int64)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, Hashed]]:
    """Ranges (doc_id, no, ended, raw, ..) in groups of about BATCH_CHARS characters, with their hashes."""
    for b in batches:
        length = pa.compute.binary_length(b.column("raw")).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(length):
            upto = max(at + 1, at + int(np.searchsorted(np.cumsum(length[at:]), BATCH_CHARS, side="right")))
            part = b.slice(at, upto - at)
            texts = [decoded(raw, no, size) for raw, no in zip(part.column("raw").to_pylist(), part.column("no").to_pylist(), strict=True)]
            yield part, Hashed(texts, part.column("ended").to_pylist())
            at = upto


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _owned(t: Hashed, stretch: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(place, lo, hi) of each anchor: [lo, hi) is what its windows cover together. The leftmost least run only
    moves forward, so an anchor's windows follow each other and each window has one anchor."""
    window, place = t.anchors(stretch, anchor)
    if not len(place):
        return place, place, place
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    last = np.ones(len(place), bool)
    last[:-1] = new[1:]
    return place[new], window[new], window[last] + stretch


def _hashes(batches: Iterator[pa.RecordBatch], size: int, stretch: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(hash, doc_id) of all sentence runs and anchors."""
    for b, t in _groups(batches, size):
        lo, hi = t.sentence_runs(stretch)
        place = _owned(t, stretch, anchor)[0]
        doc = t.doc_of(np.concatenate([lo, place]))
        h = np.concatenate([t.runs(lo, hi), t.runs(place, place + anchor)])
        yield pa.RecordBatch.from_arrays([_signed(h), pa.array(b.column("doc_id").to_numpy()[doc])], names=["hash", "doc_id"])


_RUN = "hash long, doc_id long, no int, own int, lo int, hi int, around long, place int, left long, right long"


def _rows(batches: Iterator[pa.RecordBatch], size: int, stretch: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Sentence runs (``around`` null) and anchors with what their windows cover, [lo, hi) from the range's start. A window
    with an anchor at ``place`` has half of its other characters before or behind: ``left`` and ``right`` are the
    hashes of the anchor with so many before or behind (0 where the text has fewer)."""
    half = (stretch - anchor) // 2
    for b, t in _groups(batches, size):
        lo, hi = t.sentence_runs(stretch)
        place, begin, end = _owned(t, stretch, anchor)
        h = np.concatenate([t.runs(lo, hi), t.runs(place, place + anchor)])
        none = np.zeros(len(lo), np.uint64)
        around = np.concatenate([none, t.runs(begin, end)])
        left = np.where(place - half >= begin, t.runs(np.maximum(place - half, begin), place + anchor), np.uint64(0))
        right = np.where(place + anchor + half <= end, t.runs(place, np.minimum(place + anchor + half, end)), np.uint64(0))
        place = np.concatenate([lo, place])
        begin, end = np.concatenate([lo, begin]), np.concatenate([hi, end])
        doc = t.doc_of(begin)
        yield pa.RecordBatch.from_arrays(
            [
                _signed(h),
                *(pa.array(b.column(c).to_numpy()[doc]) for c in ("doc_id", "no")),
                *(pa.array(x.astype(np.int32)) for x in (t.own[doc], begin - t.starts[doc], end - t.starts[doc])),
                pa.array(around.view(np.int64), mask=np.arange(len(begin)) < len(lo)),
                pa.array((place - t.starts[doc]).astype(np.int32)),
                *(_signed(np.concatenate([none, x])) for x in (left, right)),
            ],
            names=["hash", "doc_id", "no", "own", "lo", "hi", "around", "place", "left", "right"],
        )


def _windows(batches: Iterator[pa.RecordBatch], size: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, no, ended, raw, los, his) to a row for each window in the spans [lo, hi)."""
    for b, t in _groups(batches, size):
        parts = [
            np.arange(x, y - stretch + 1) + at
            for at, los, his in zip(t.starts, b.column("los").to_pylist(), b.column("his").to_pylist(), strict=True)
            for x, y in zip(los, his, strict=True)
        ]
        window = np.unique(np.concatenate(parts))
        doc = t.doc_of(window)
        yield pa.RecordBatch.from_arrays(
            [
                _signed(t.runs(window, window + stretch)),
                *(pa.array(b.column(c).to_numpy()[doc]) for c in ("doc_id", "no")),
                *(pa.array(x.astype(np.int32)) for x in (t.own[doc], window - t.starts[doc])),
            ],
            names=["hash", "doc_id", "no", "own", "lo"],
        )


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in two documents or more; the documents' least and greatest id are found map-side, so a
    run that a third of all documents holds is one row a task."""
    ends = rows.groupBy(key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return ends.filter("a <> b").select(key)


def shared_spans(docs: DataFrame, stretch: int = MIN_CHARS, anchor: int = ANCHOR, size: int = RANGE) -> DataFrame:
    """(doc_id, no, own, lo, hi, by): stretches of at least ``stretch`` characters that stand verbatim in the text of
    another document, as places in range ``no`` of the text, which has ``own`` characters; a span may reach into the next
    range. They overlap, and their union is exactly the shared characters. ``by`` names the step that found them.

    Null texts, texts under ``stretch`` characters and null doc_ids are left out; rows that repeat a doc_id are
    the same document; an empty table gives no rows. Texts are looked at in ranges of ``size`` bytes with halos.

    (1) ``sentences``: the run of consecutive sentences from each sentence on that makes ``stretch`` characters is hashed,
    runs are joined over all documents, and one that stands in two is shared whole.
    A stretch that counts needn't hold a whole sentence, so what runs can't prove is checked: (2) ``anchors``: each window of
    ``stretch`` characters has an anchor in it, where it is in any text; anchors in two documents are found in the same
    aggregation, what the windows of one cover together is hashed, and if it stands in two documents, it is shared
    whole. (3) ``windows``: where it isn't, and no run of sentences covers it, a window that is shared has half of what it
    has besides the anchor on one side of it; if the anchor with that half stands in two documents, each window on that side is
    hashed and looked up, in these documents and in two documents for each run of (2) with that half (two, as one of
    them may be the document that looks)."""
    if size < 16 * stretch + LEAD:
        raise ValueError("a range is shorter than its halo")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= stretch))
    cut = byte_ranges(docs, "text", size, 16 * stretch).select("doc_id", "no", "ended", "raw")
    first = cut.mapInArrow(lambda it: _hashes(it, size, stretch, anchor), "hash long, doc_id long")
    known = materialise(_repeated(first, "hash"), "known")
    rows = cut.mapInArrow(lambda it: _rows(it, size, stretch, anchor), _RUN)
    rows = materialise(only_in(rows, known, "hash"), "found")

    spans = rows.filter("around is null")
    proven = F.max(F.when(F.col("around").isNull(), F.col("hi"))).over(Window.partitionBy("doc_id", "no").orderBy("lo"))
    rows = materialise(rows.withColumn("covered", F.coalesce(proven >= F.col("hi"), F.lit(False))).filter("around is not null"), "anchors")
    ends = rows.groupBy("hash", "around").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    ends = materialise(ends.select("hash", "around", (F.col("a") != F.col("b")).alias("proven")), "around")

    half = (stretch - anchor) // 2
    side = lambda h, lo, hi: F.struct(F.col(h).alias("half"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    before = side("left", F.col("lo"), F.least(F.col("hi"), F.col("place") - half + stretch))
    behind = side("right", F.greatest("lo", F.col("place") - half + 1), F.col("hi"))
    sides = rows.join(ends, ["hash", "around"]).select("doc_id", "no", "around", (~F.col("proven") & ~F.col("covered")).alias("asks"), F.explode(F.array(before, behind)).alias("s"))
    sides = materialise(sides.select("doc_id", "no", "around", "asks", "s.*").filter(f"half <> 0 and hi - lo >= {stretch}"), "sides")
    wanted = sides.groupBy("half").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.bool_or("asks").alias("asks")).filter("a <> b and asks").select("half")
    cand = sides.join(wanted, "half", "left_semi").groupBy("half", "around").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    cand = cand.select("half", "around", F.explode(F.array_distinct(F.array("a", "b"))).alias("doc_id"))
    asked = sides.join(cand, ["half", "around", "doc_id"], "left_semi").groupBy("doc_id", "no")
    asked = materialise(asked.agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")), "edges")
    texts = byte_ranges(only_in(docs, asked.select("doc_id").distinct(), "doc_id", exact=False), "text", size, 16 * stretch).join(asked, ["doc_id", "no"])
    windows = texts.select("doc_id", "no", "ended", "raw", "los", "his").mapInArrow(lambda it: _windows(it, size, stretch), "hash long, doc_id long, no int, own int, lo int")
    windows = materialise(windows, "windows")
    single = windows.join(_repeated(windows, "hash"), "hash", "left_semi")
    whole = rows.join(ends.filter("proven"), ["hash", "around"], "left_semi")
    at = ("doc_id", "no", "own", "lo")
    return (
        spans.select(*at, "hi", F.lit("sentences").alias("by"))
        .unionByName(whole.select(*at, "hi", F.lit("anchors").alias("by")))
        .unionByName(single.select(*at, (F.col("lo") + stretch).alias("hi"), F.lit("windows").alias("by")))
    )


def only_in(rows: DataFrame, keys: DataFrame, key: str, exact: bool = True) -> DataFrame:
    """Rows whose key is in ``keys``; a Bloom filter of bounded size spares most others the shuffle."""
    blocks = filter_size(keys.count())
    some = probe(rows, key, bloom_blocks(keys, key, blocks), blocks, "maybe").filter("maybe").drop("maybe")
    return some.join(keys, key, "left_semi") if exact else some


def shared_chars(spans: DataFrame) -> DataFrame:
    """(doc_id, shared_chars): characters in the union of each document's spans (doc_id, no, own, lo, hi). Rows that
    repeat count once; documents without a span have no row. What reaches beyond a range counts in the next."""
    part = F.explode(
        F.filter(
            F.array(
                F.struct("no", "lo", F.least("hi", "own").alias("hi")), F.struct((F.col("no") + 1).alias("no"), F.lit(0).alias("lo"), (F.col("hi") - F.col("own")).alias("hi"))
            ),
            lambda x: x["hi"] > x["lo"],
        )
    )
    parts = spans.select("doc_id", part.alias("p")).select("doc_id", "p.*")
    before = Window.partitionBy("doc_id", "no").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    edge = parts.groupBy("doc_id", "no", "lo").agg(F.max("hi").alias("hi")).withColumn("reach", F.coalesce(F.max("hi").over(before), F.lit(0)))
    new = F.greatest(F.col("hi") - F.greatest("lo", "reach"), F.lit(0)).cast("long")
    return edge.groupBy("doc_id").agg(F.sum(new).alias("shared_chars"))


def _sentence_runs(batches: Iterator[pa.RecordBatch], several: int) -> Iterator[pa.RecordBatch]:
    import re

    import xxhash

    pat = re.compile(r"[^.!?。\n]+[.!?。]*")
    for b in batches:
        docs, nos, sizes, hashes = [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = [x for m in pat.finditer(text) if (x := m.group().strip())]
            for no in range(max(1, len(parts) - several + 1) if parts else 0):
                run = parts[no : no + several]
                docs.append(doc)
                nos.append(no)
                sizes.append(len(parts))
                hashes.append(xxhash.xxh64_intdigest("\x00".join(run)) - (1 << 63) if len(run) == several else None)
        cols = (docs, pa.int64()), (nos, pa.int32()), (sizes, pa.int32()), (hashes, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in cols], names=["doc_id", "no", "n_sentences", "hash"])


def sentence_spans(docs: DataFrame, several: int = 3) -> DataFrame:
    """(doc_id, n_sentences, n_repeated): sentences of each document, and those that a run of ``several``
    sentences covers which also stands earlier (in a document with a lesser id, or before in the same).

    Sentences end at ``.``, ``!``, ``?``, ``。`` or a line's end and compare without blanks around. Texts with fewer
    sentences have none repeated; null texts, null ids and texts without sentences have no row. A run's first place
    is found map-side, so a run in a third of all documents is one row a task."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    runs = materialise(docs.mapInArrow(lambda it: _sentence_runs(it, several), "doc_id long, no int, n_sentences int, hash long"), "runs")
    first = runs.filter("hash is not null").groupBy("hash").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    later = runs.join(first, "hash").filter(F.struct("doc_id", "no") != F.col("first"))
    covered = later.select("doc_id", F.explode(F.sequence(F.col("no"), F.col("no") + several - 1)).alias("s")).distinct()
    covered = covered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_repeated"))
    sizes = runs.groupBy("doc_id").agg(F.max("n_sentences").cast("long").alias("n_sentences"))
    return sizes.join(covered, "doc_id", "left").select("doc_id", "n_sentences", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"))
