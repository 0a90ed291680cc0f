"""Evaluation passages inside a training corpus, by generalised suffix automata of the items' words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.ranges import byte_ranges, decoded
from strataleaf.llm.words import word_pattern, words
from strataleaf.session import materialise

#: Words in a row that make a leak; bytes of a document that are looked at as one.
MIN_WORDS, RANGE = 12, 1 << 16
#: Words of one automaton, and of all automata that are sent to the tasks at once: about 40 bytes a word there, and
#: 1 kB a word of one automaton while it is built.
SHARD_WORDS, PASS_WORDS = 1 << 17, 1 << 21
#: Words of documents that are streamed through the automata at the same time.
BATCH_WORDS = 200_000


class SuffixAutomaton:
    """Of several word sequences: each state stands for the word runs with the same set of ends in the sequences.

    After building only flat arrays are kept: transitions as sorted codes, ``link`` (the longest shorter run's
    state), ``length`` (the longest run), and the sequences' numbers at their ends in the order of a walk through
    the link tree, in which each state's ends are one stretch [``begin``, ``end``)."""

    def __init__(self, sequences: list[list[int]], width: int, least: int):
        self.width, self.least = max(width, 1), least
        goto, link, length = [{}], [-1], [0]

        def split(p: int, w: int, q: int) -> int:
            goto.append(dict(goto[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            clone = len(link) - 1
            link[q] = clone
            while p >= 0 and goto[p].get(w) == q:
                goto[p][w] = clone
                p = link[p]
            return clone

        def extend(p: int, w: int) -> int:
            q = goto[p].get(w)
            if q is not None:
                return q if length[q] == length[p] + 1 else split(p, w, q)
            goto.append({})
            link.append(0)
            length.append(length[p] + 1)
            new = len(link) - 1
            while p >= 0 and w not in goto[p]:
                goto[p][w] = new
                p = link[p]
            if p >= 0:
                q = goto[p][w]
                link[new] = q if length[q] == length[p] + 1 else split(p, w, q)
            return new

        at, whose = [], []
        for k, seq in enumerate(sequences):
            last = 0
            for w in seq:
                last = extend(last, w)
                at.append(last)
                whose.append(k)
        n = len(link)
        size = np.fromiter((len(g) for g in goto), np.int64, n)
        keys = np.repeat(np.arange(n), size) * self.width + np.fromiter((w for g in goto for w in g), np.int64, int(size.sum()))
        to = np.fromiter((t for g in goto for t in g.values()), np.int32, len(keys))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self._walk(np.array(at, np.int64), np.array(whose, np.int32))

    def _walk(self, at: np.ndarray, whose: np.ndarray) -> None:
        """Number the ends so that those of a state and of all states that link to it are one stretch."""
        n, link = len(self.link), self.link
        by_length = np.argsort(self.length, kind="stable")
        own = np.bincount(at, minlength=n)
        below = own.copy()
        for s in by_length[:0:-1]:
            below[link[s]] += below[s]
        begin, free = np.zeros(n, np.int64), own.copy()
        for s in by_length[1:]:
            p = link[s]
            begin[s] = begin[p] + free[p]
            free[p] += below[s]
        self.begin, self.end = begin.astype(np.int32), (begin + below).astype(np.int32)
        order = np.argsort(at, kind="stable")
        place = begin[at[order]] + np.arange(len(at)) - np.searchsorted(at[order], at[order])
        self.whose = np.empty(len(at), np.int32)
        self.whose[place] = whose[order]
        self.top = np.arange(n, dtype=np.int32)
        for s in by_length[1:]:
            if self.length[link[s]] >= self.least:
                self.top[s] = self.top[link[s]]

    def _step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next state, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(state), -1)
        code = state.astype(np.int64) * self.width + word
        k = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        return np.where((self.keys[k] == code) & (word >= 0), self.to[k], -1)

    def matches(self, seq: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (in ``seq``, exclusive), lengths and states of the longest matches of at least ``least`` words that
        end there, over the stretches [begin, end) of ``seq``. All stretches are streamed at the same time."""
        order = np.argsort(begin - end, kind="stable")
        begin, end = begin[order], end[order]
        state, have = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for step in range(int((end - begin).max(initial=0))):
            live = int(np.searchsorted(begin - end, -step, side="left"))
            word, cur, n = seq[begin[:live] + step], state[:live].copy(), have[:live].copy()
            to = self._step(cur, word)
            open_ = np.flatnonzero((to < 0) & (cur > 0))
            while len(open_):
                cur[open_] = self.link[cur[open_]]
                n[open_] = self.length[cur[open_]]
                to[open_] = self._step(cur[open_], word[open_])
                open_ = open_[(to[open_] < 0) & (cur[open_] > 0)]
            state[:live], have[:live] = np.maximum(to, 0), np.where(to < 0, 0, n + 1)
            full = np.flatnonzero(have[:live] >= self.least)
            if len(full):
                out.append((begin[full] + step + 1, have[full], state[full]))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def sequences(self, state: int) -> np.ndarray:
        """Numbers of the sequences that hold the shortest of the state's runs of at least ``least`` words."""
        s = self.top[state]
        return np.unique(self.whose[self.begin[s] : self.end[s]])


class LeakFinder:
    """Automata of some items with the words' numbers and the items' ids; made on the driver, used in each task."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int, shard: int = SHARD_WORDS):
        self.least = least
        self.numbers: dict[str, int] = {}
        seqs = [(i, [self.numbers.setdefault(w, len(self.numbers)) for w in ws]) for i, ws in items]
        self.longest = max(map(len, self.numbers), default=0)
        self.width = len(self.numbers) + 1
        pairs = [np.unique(np.array(s[:-1], np.int64) * self.width + np.array(s[1:], np.int64)) for _, s in seqs if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.shards: list[tuple[np.ndarray, SuffixAutomaton]] = []
        for part in in_parts(seqs, shard, least):
            self.shards.append((np.array([i for i, _ in part], np.int64), SuffixAutomaton([s for _, s in part], self.width, least)))

    def numbered(self, own: str, halo: str, before: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Numbers (-1: a word of no item) and places of the words that begin in ``own``. A word that goes on beyond
        the halo is longer than any item's."""
        get, pat = self.numbers.get, word_pattern()
        skip = pat.match(own) if before and pat.match(before) else None
        at = [m.span() for m in pat.finditer(own + halo, skip.end() if skip else 0) if m.start() < len(own)]
        text = own + halo
        return np.fromiter((get(text[a:z].lower(), -1) for a, z in at), np.int64, len(at)), at

    def stretches(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ``seq`` in which each two neighbours are neighbours in some item, if long enough: outside of
        these no match of ``least`` words can lie, so the automata needn't see it."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(seq) or not self.shards:
            return none
        if self.least < 2:
            known = np.concatenate([[False], seq >= 0, [False]])
            edge = np.flatnonzero(np.diff(known.view(np.int8)))
            return edge[::2], edge[1::2]
        if not len(self.pairs):
            return none
        code = seq[:-1] * self.width + seq[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        ok = (seq[:-1] >= 0) & (seq[1:] >= 0) & (self.pairs[at] == code)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        a, b = edge[::2], edge[1::2] + 1
        long = b - a >= self.least
        return a[long], b[long]

    def found(self, seq: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(place, item id) of matches in ``seq``, each stretch's items once, and all spans that stand in some item."""
        begin, end = self.stretches(seq)
        hits: set[tuple[int, int]] = set()
        spans: list[tuple[int, int]] = []
        for ids, automaton in self.shards if len(begin) else ():
            place, have, state = automaton.matches(seq, begin, end)
            spans += zip((place - have).tolist(), place.tolist(), strict=True)
            home = begin[np.searchsorted(begin, place - 1, side="right") - 1]
            for h, s in set(zip(home.tolist(), automaton.top[state].tolist(), strict=True)):
                hits.update((h, i) for i in ids[automaton.sequences(s)].tolist())
        return sorted(hits), spans


def in_parts(seqs: list[tuple[int, list]], most: int, least: int) -> Iterator[list[tuple[int, list]]]:
    """Items in groups of at most ``most`` words; a longer item is cut into parts that overlap by ``least`` - 1 words,
    so each run of ``least`` words is in one of them."""
    group, n = [], 0
    most = max(most, 2 * least)
    for i, s in seqs:
        for at in range(0, max(len(s) - least + 1, 1), most - least + 1):
            part = s[at : at + most]
            if len(part) < least:
                continue
            if n + len(part) > most and group:
                yield group
                group, n = [], 0
            group.append((i, part))
            n += len(part)
    if group:
        yield group


def _finders(items: DataFrame, least: int, pass_words: int, shard_words: int) -> Iterator:
    """Finders of all items, each sent to the tasks: one for each ``pass_words`` words of items. The items stream through
    the driver, which holds no more than one pass of them."""
    context = items.sparkSession.sparkContext
    rows = items.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    group: list[tuple[int, list[str]]] = []
    n = 0
    for r in rows.toLocalIterator():
        for part in in_parts([(r[0], words(r[1]))], pass_words, least):
            size = sum(len(s) for _, s in part)
            if group and n + size > pass_words:
                yield context.broadcast(LeakFinder(group, least, shard_words))
                group, n = [], 0
            group += part
            n += size
    yield context.broadcast(LeakFinder(group, least, shard_words))


def _streamed(finder: LeakFinder, size: int, batches: Iterator[pa.RecordBatch], places: bool = False) -> Iterator[tuple]:
    """(row, numbers, places, index) for each range (row, no, n_ranges, ended, raw): its words after the last few of the range before,
    their places as bytes of the text, and the first's index among the text's words. Ranges of a text follow each other."""
    seq, ends, index = np.empty(0, np.int64), np.empty((0, 2), np.int64), 0
    for b in batches:
        for row, no, raw in zip(*(b.column(c).to_pylist() for c in ("row", "no", "raw")), strict=True):
            before, own, halo, at = decoded(raw, no, size)
            new, spans = finder.numbered(own, halo, before)
            keep = max(len(seq) - finder.least + 1, 0) if no else len(seq)
            if places:
                own_ends = np.array(spans, np.int64).reshape(-1, 2)
                if not (own.isascii() and halo.isascii()):
                    code = np.frombuffer((own + halo).encode("utf-32-le"), np.uint32)
                    width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
                    own_ends = np.concatenate([[0], np.cumsum(width)])[own_ends]
                ends = np.concatenate([ends[keep:], own_ends + at])
            index = index + keep if no else 0
            seq = np.concatenate([seq[keep:], new])
            yield row, seq, ends, index


def _over(docs: DataFrame, key: str, finder, size: int) -> DataFrame:
    """``docs`` in ranges, (row, no, n_ranges, ended, raw), with halos as long as the longest word of an item."""
    return byte_ranges(docs.select(F.col(key).alias("row"), "text"), "text", size, 4 * (finder.value.longest + 2))


def leaked_documents(
    docs: DataFrame, items: DataFrame, least: int = MIN_WORDS, size: int = RANGE, pass_words: int = PASS_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(doc_id, item_id): documents that have at least ``least`` words in a row in common with the item's text.

    Words are compared lower-cased, as runs of letters and digits, so case, punctuation and layout don't
    matter. Null and empty texts hold nothing; null ids are kept; rows are distinct; an empty table on either
    side gives no rows. Documents are streamed where they are read, in ranges of ``size`` bytes of which each takes the
    last words of the one before: no shuffle but the last distinct.

    Items are split into automata of ``shard_words`` words. Up to ``pass_words`` words are sent to the tasks at once, which
    bounds their memory; more items take more passes over the documents, whose results are united."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")

    def one(finder) -> DataFrame:
        def found(owner: list, seqs: list[np.ndarray]) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, seqs[:-1])])
            hits = finder.value.found(np.concatenate(seqs))[0] if seqs else []
            ids = [owner[int(np.searchsorted(starts, h, side="right")) - 1] for h, _ in hits]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i for _, i in hits], pa.int64())], names=["doc_id", "item_id"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owner, seqs, n = [], [], 0
            for row, seq, _, _ in _streamed(finder.value, size, batches):
                owner.append(row)
                seqs.append(np.append(seq, -1))
                n += len(seq)
                if n > BATCH_WORDS:
                    yield found(owner, seqs)
                    owner, seqs, n = [], [], 0
            yield found(owner, seqs)

        return _over(docs, "doc_id", finder, size).mapInArrow(run, "doc_id long, item_id long")

    return reduce(DataFrame.unionByName, [one(f) for f in _finders(items, least, pass_words, shard_words)]).distinct()


def without_leaks(
    docs: DataFrame, items: DataFrame, least: int = MIN_WORDS, max_share: float = 0.5, size: int = RANGE, pass_words: int = PASS_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(doc_id, text, n_removed) with leaked spans taken out, from their first word to their last; n_removed counts their
    words. Documents of which the spans cover more than ``max_share`` of the words are left out. Null texts, and those
    without a leak, pass unchanged; a repeated row gives a row each.

    A span is a longest match of at least ``least`` words with an item. Spans are found in ranges and passes as in
    :func:`leaked_documents`; those of one text, at most one a word, are united before they are taken out."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(rows, "texts")

    def one(finder) -> DataFrame:
        def spans_of(held: list[tuple]) -> pa.RecordBatch:
            starts = np.cumsum([0, *[len(h[1]) + 1 for h in held]])
            out = [(row, None, None, None, None, index + len(seq)) for row, seq, _, index in held]
            for a, z in finder.value.found(np.concatenate([np.append(h[1], -1) for h in held]))[1]:
                k = int(np.searchsorted(starts, a, side="right")) - 1
                row, _, ends, index = held[k]
                a, z = a - int(starts[k]), z - int(starts[k])
                out.append((row, index + a, index + z, int(ends[a, 0]), int(ends[z - 1, 1]), 0))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["row", "a", "z", "lo", "hi", "words"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for part in _streamed(finder.value, size, batches, True):
                held.append(part)
                n += len(part[1])
                if n > BATCH_WORDS:
                    yield spans_of(held)
                    held, n = [], 0
            if held:
                yield spans_of(held)

        return _over(rows.filter("text is not null"), "row", finder, size).mapInArrow(run, "row long, a long, z long, lo long, hi long, words long")

    spans = reduce(DataFrame.unionByName, [one(f) for f in _finders(items, least, pass_words, shard_words)])
    of_text = F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "z", "lo", "hi"))))
    spans = spans.groupBy("row").agg(of_text.alias("spans"), F.max("words").alias("words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, raw, spans_, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts, at, gone, seen = [], 0, 0, 0
                for s in spans_ or ():
                    if s["z"] > seen:
                        if s["a"] >= seen:
                            parts.append(raw[at : s["lo"]])
                        gone += s["z"] - max(s["a"], seen)
                        at, seen = s["hi"], s["z"]
                if gone <= max_share * (n or 0):
                    out.append((doc, None if raw is None else b"".join([*parts, raw[at:]]).decode("utf-8", "replace"), gone))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "text", "n_removed"])

    both = rows.join(spans, "row", "left").select("doc_id", F.col("text").cast("binary").alias("raw"), "spans", "words")
    return both.mapInArrow(cut, "doc_id long, text string, n_removed long")
