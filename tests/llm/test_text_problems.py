"""The text problems against plain Python: small tables with nulls, empty and long texts, copies and repeated rows,
and columns whose names clash with the operators' own."""

import random
import re
from collections import defaultdict

import pytest

from strataleaf.llm import queries
from strataleaf.llm.encoding import TOKENIZERS, decode, encode_corpus, encoder
from strataleaf.llm.leakage import LeakFinder, leaked_documents, without_leaks
from strataleaf.llm.nearcopies import near_copies
from strataleaf.llm.spans import sentence_spans, shared_chars, shared_spans
from strataleaf.llm.splitting import pieces, split_files, split_nodes, split_texts
from strataleaf.llm.words import words

PARTS = ["a ", "bb", "\n", "\n\n", ". ", "。", "  \t", "\r", " " * 15, "x" * 20, "word ", "? "]


def plain_pieces(t, limit, least, repeat):
    kinds = [
        {m.start() + len(m.group(1)) for m in re.finditer(r"(?=(\n[ \t\r]*\n))", t)},
        {i + 1 for i, c in enumerate(t) if c == "\n"},
        {i + 1 for i, c in enumerate(t) if c in " \t" and i and t[i - 1] in ".!?" or c == "。"},
        {i + 1 for i, c in enumerate(t) if c in " \t"},
    ]
    s, out = 0, []
    while len(t) - s > limit:
        end = next((max(x) for k in kinds if (x := [p for p in k if s + least <= p <= s + limit])), s + limit)
        out.append((s, end))
        s = end - repeat
    return [*out, (s, len(t))]


@pytest.mark.parametrize("limit,least,repeat,size", [(30, 15, 4, 7), (30, 15, 4, 31), (30, 15, 10, 70), (40, 20, 6, 100000)])
def test_pieces(spark, limit, least, repeat, size):
    r = random.Random(limit + size)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 200)))) for i in range(60)] + [(-1, None), (-2, "")]
    got = defaultdict(list)
    for x in split_texts(spark.createDataFrame(rows, "row long, text string"), limit, least, repeat, size).collect():
        got[x.row].append((x.piece_no, x.start_pos, x.end_pos))
    for i, t in rows:
        want = [(k, *p) for k, p in enumerate(plain_pieces(t, limit, least, repeat), 1)] if t and len(t) > limit else []
        assert sorted(got[i]) == want


def test_pieces_of_a_giant_text(spark, tmp_path):
    """Production parameters over 5 million characters, as a cell and as a file."""
    r = random.Random(11)
    parts = ["word ", "日本。", "é", "line\n", "\n \t\n", "End. ", "x" * 900, "no ", "words here ", " " * 40]
    t = "".join(r.choices(parts, [9, 1, 2, 1, 1, 2, 0.5, 9, 9, 0.3], k=400_000))
    t = t[:2_500_000] + " " * 20_000 + "y" * 30_000 + "\n" * 9_000 + t[2_500_000:5_000_000]
    want = [("a", k, *p) for k, p in enumerate(pieces(t), 1)]
    got = split_texts(spark.createDataFrame([("a", t), ("b", "short")], "row string, text string"))
    assert sorted(tuple(x) for x in got.collect()) == want
    path = tmp_path / "giant.txt"
    path.write_bytes(t.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    got = split_files(spark, [str(path), str(tmp_path / "empty.txt")], size=1 << 16)
    assert sorted(tuple(x) for x in got.collect()) == [(str(path), *w[1:]) for w in want]


def test_pieces_of_nodes(spark):
    big, other = "word. " * 900, "line\n" * 700
    rows = [("N1", "short", 2), ("n1 ", big, 1), ("n2", big, 3), ("n2", big, 3), ("N2", other, 1), (None, big, 1), ("n3", None, None), ("n4", other, None)]
    df = spark.createDataFrame([(a, b, c, "t") for a, b, c in rows], "node_id string, content string, d int, `text` string")
    df = df.selectExpr("node_id", "content", "timestamp_seconds(d) ingestion_date", "text")
    got = {tuple(x) for x in split_nodes(df).collect()}
    assert got == {(n, k, a, b) for n, t in (("n2", big), ("n4", other)) for k, (a, b) in enumerate(pieces(t), 1)}
    assert split_nodes(df.limit(0)).count() == 0


def triples(t):
    w = words(t or "")
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


@pytest.mark.parametrize("hot", [50_000, 5])
def test_near_copies(spark, hot):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(18, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        w = r.choice(base[: 3 if i % 3 else 12]).split()
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w = w[len(w) // 2 :] + w[: len(w) // 2]
        rows.append((f"v{i:03}", (" " if i % 2 else ", ").join(w).title(), i, 1))
    rows += [("v000", None, 999, 1), ("z", "", 1, 1), (None, base[0], 1, 1), ("y", None, None, 1), ("v001", rows[1][1], 1, 1)]
    best = {}
    for v, t, u, _ in rows:
        if v is not None and (v not in best or (u or -1) > best[v][0]):
            best[v] = (u or -1, triples(t))
    ids = sorted(v for v, (_, s) in best.items() if s)
    low = {v: v for v in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                x, y = best[a][1], best[b][1]
                if a < b and low[a] != low[b] and 10 * len(x & y) >= 7 * len(x | y):
                    low[a] = low[b] = min(low[a], low[b])
        if all(low[low[v]] == low[v] for v in ids):
            break
    groups = defaultdict(list)
    for v in ids:
        groups[low[v]].append(v)
    want = {(min(g), v) for g in groups.values() if len(g) > 1 for v in g}
    df = spark.createDataFrame(rows, "version_id string, content string, u int, `set_id` int").selectExpr("version_id", "content", "timestamp_seconds(u) updated_at", "set_id")
    assert {tuple(x) for x in near_copies(df, hot=hot).collect()} == want
    assert want


def test_near_copies_of_nothing(spark):
    assert near_copies(spark.createDataFrame([], "version_id string, content string, updated_at timestamp")).count() == 0


MIX = ["  ", "\n\n", "a", "word", "'s", "'ll", "日本", "é", "1234", " x", "\t", "  \n", "!?", "z" * 30, "<|endoftext|>"]


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (37, 30), (1 << 12, 1 << 9)])
def test_encoding(spark, chunk, overlap):
    r = random.Random(chunk)
    rows = [(i, "".join(r.choice(MIX) for _ in range(r.randint(0, 120)))) for i in range(80)] + [(-1, None), (-2, ""), (None, "x")]
    enc = encoder(TOKENIZERS, "byte_bpe_50k")
    df = spark.createDataFrame([(a, b, 1, "i") for a, b in rows], "doc_id long, text string, `row` int, `ids` string")
    got = {x.doc_id: x.ids for x in encode_corpus(df, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in rows}
    assert all(decode(got[i]) == (t or "") for i, t in rows)
    assert encode_corpus(df.limit(0)).count() == 0


def test_encoding_of_a_giant_text(spark):
    """Production parameters over 5 million characters; runs longer than the overlap, in the middle and at both ends."""
    r = random.Random(5)
    t = "".join(r.choices(MIX, k=1_700_000))
    t = " " * 9_000 + t[:2_000_000] + "ab" * 6_000 + t[2_000_000:4_000_000] + "\n" * 5_000 + t[4_000_000:5_000_000] + "日" * 3_000
    rows = [(1, t), (2, "short"), (3, "x" * 4_095 + "é" * 2), (4, " " * 10_000)]
    enc = encoder(TOKENIZERS, "byte_bpe_50k")
    got = {x.doc_id: x.ids for x in encode_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == enc.encode_ordinary(text)


@pytest.mark.parametrize("shard", [12, 1000])
def test_suffix_automaton(shard):
    r = random.Random(3)
    items = [[str(r.randrange(4)) for _ in range(r.randrange(1, 30))] for _ in range(6)]
    f = LeakFinder(list(enumerate(items)), 5, shard)
    for _ in range(200):
        text = [str(r.randrange(5)) for _ in range(40)]
        runs = {tuple(text[i : i + 5]) for i in range(36)}
        want = {k for k, s in enumerate(items) if any(tuple(s[i : i + 5]) in runs for i in range(len(s) - 4))}
        hits, spans = f.found(f.numbered(" ".join(text), "", "")[0])
        assert {k for _, k in hits} == want
        covered = {i for a, z in spans for i in range(a, z)}
        assert covered == {j for i in range(36) if any(tuple(text[i : i + 5]) == tuple(s[k : k + 5]) for s in items for k in range(len(s) - 4)) for j in range(i, i + 5)}


@pytest.mark.parametrize("size,pass_words,shard", [(1 << 16, 1 << 21, 1 << 17), (50, 30, 13), (31, 1000, 20)])
def test_leaks(spark, size, pass_words, shard):
    how = {"size": size, "pass_words": pass_words, "shard_words": shard}
    one = "The quick brown fox jumps over the lazy dog near the old river bank today"
    items = spark.createDataFrame([(1, one, "q"), (2, "Other words " * 3, "q"), (3, None, "q"), (4, "before " + one, "q")], "item_id long, text string, `doc_id` string")
    docs = [(1, one.upper()), (2, "xx " + ", ".join(one.split()[2:14]) + " yy"), (3, " ".join(one.split()[:11])), (4, None), (5, ""), (6, "other words " * 8), (1, one.upper())]
    docs += [(7, "é日 " * 30 + ("-" * 70).join(one.split()) + " 日é" * 30 + "u" * 200)]
    df = spark.createDataFrame([(a, b, 7) for a, b in docs], "doc_id long, text string, `item_id` int")
    assert {tuple(x) for x in leaked_documents(df, items, **how).collect()} == {(1, 1), (1, 4), (2, 1), (2, 4), (7, 1), (7, 4)}
    assert leaked_documents(df, items, least=6, **how).filter("doc_id = 6 and item_id = 2").count() == 1
    assert leaked_documents(df, items.limit(0), **how).count() == 0
    assert leaked_documents(df.limit(0), items, **how).count() == 0
    left = {x.doc_id: (x.text, x.n_removed) for x in without_leaks(df, items, max_share=0.9, **how).collect()}
    assert left[2] == ("xx  yy", 12) and left[4] == (None, 0) and 1 not in left and left[5] == ("", 0)
    assert left[7] == ("é日 " * 30 + " 日é" * 30 + "u" * 200, 15)
    assert without_leaks(df, items.limit(0), **how).count() == len(docs)


def test_many_items():
    """Memory of the automata that are sent at once: 200,000 words of items, the bytes a word as stated."""
    r = random.Random(1)
    f = LeakFinder([(i, [f"w{r.randrange(30_000)}" for _ in range(100)]) for i in range(2_000)], 12)
    held = sum(x.nbytes for _, a in f.shards for x in vars(a).values() if hasattr(x, "nbytes"))
    assert len(f.shards) == 2 and held < 70 * 200_000
    assert f.found(f.numbered("w1 w2", "", "")[0]) == ([], [])


def plain_shared(rows, n):
    texts = dict(rows)
    owners = defaultdict(set)
    for d, t in texts.items():
        for s in range(len(t or "") - n + 1):
            owners[t[s : s + n]].add(d)
    out = {}
    for d, t in texts.items():
        hit = {i for s in range(len(t or "") - n + 1) if len(owners[t[s : s + n]]) > 1 for i in range(s, s + n)}
        if hit:
            out[d] = len(hit)
    return out


@pytest.mark.parametrize("seed,size", [(0, 1 << 16), (1, 1 << 16), (2, 1 << 16), (0, 800), (2, 644)])
def test_shared(spark, seed, size):
    r = random.Random(seed)
    letters = "ab" if seed == 2 else "abcdefghé日\n ."
    long = "".join(r.choice(letters) for _ in range(600))
    rows = [(0, long), (1, long), (2, long[50:300] + "Q" + long[100:140]), (3, None), (4, ""), (5, "-" * 300), (6, "-" * 90)]
    for i in range(10, 40):
        t = ""
        for _ in range(r.randrange(1, 5)):
            s = r.randrange(550)
            t += long[s : s + r.randrange(10, 90)] + "".join(r.choice(letters) for _ in range(r.randrange(20)))
        rows.append((i, t))
    df = spark.createDataFrame([(a, b, 1) for a, b in [*rows, rows[0], rows[5]]], "doc_id long, text string, `hash` int")
    spans = shared_spans(df, 40, 20, size)
    got = {x.doc_id: x.shared_chars for x in shared_chars(spans).collect()}
    assert got == plain_shared(rows, 40)
    assert shared_spans(df.limit(0)).count() == 0


def test_shared_of_giant_texts(spark):
    """Production parameters over texts of a million characters and more."""
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefghijé日", k=r.randrange(2, 9))) for _ in range(500)]
    def text(n):
        return "".join(r.choice(vocab) + r.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n))
    a, b = text(200_000), text(200_000)
    mixed = a[300_000:420_000] + "#" + b[5_000:5_119] + "#" + b[9_000:9_120] + "#" + b[-50_000:]
    rows = [(1, a), (2, b), (3, mixed), (4, a[65_000:66_000])]
    got = {x.doc_id: x.shared_chars for x in shared_chars(shared_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: 121_000, 2: 50_120, 3: 120_000 + 120 + 50_000, 4: 1_000}


def test_sentence_spans(spark):
    a = "One is here. Two is there. Three goes on. Four ends it. "
    rows = [(1, a + "Five alone."), (2, "Start now. " + a), (3, "Two is there. Three goes on. Odd one."), (4, None), (5, ""), (6, a)]
    got = {x.doc_id: (x.n_sentences, x.n_repeated) for x in sentence_spans(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert got == {1: (5, 0), 2: (5, 4), 3: (3, 0), 6: (4, 4)}


@pytest.fixture(scope="module")
def tables():
    from pathlib import Path

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test tables")
    return d


def test_p4_of_the_whole_table(spark, tables):
    from strataleaf.sources.tables import table

    best = {}
    for r in table(spark, tables, "apex_ast_nodes").collect():
        key = (r.node_id or "").strip(" ").lower()
        order = (r.ingestion_date is not None, r.ingestion_date, r.node_id)
        if key and (key not in best or order > best[key][0]):
            best[key] = (order, r.content)
    want = {(o[2], k, *p) for o, t in best.values() if t and len(t) > 3000 for k, p in enumerate(plain_pieces(t, 3000, 1500, 200), 1)}
    assert {tuple(x) for x in queries.p4_found(spark, tables).collect()} == want and want


def test_p7_of_the_whole_table(spark, tables):
    from strataleaf.sources.tables import table

    enc = encoder(TOKENIZERS, "byte_bpe_50k")
    want = {r.doc_id: enc.encode_ordinary(r.text or "") for r in table(spark, tables, "documents").collect()}
    assert {x.doc_id: x.ids for x in queries.p7_ids(spark, tables).collect()} == want


def test_p8_of_the_cleaned_table(spark, tables):
    """After the removal no document has a passage of an item any more, unless what was around it forms one."""
    from strataleaf.sources.tables import table

    left = queries.p8_cleaned(spark, tables)
    rows = left.collect()
    found = {x.doc_id for x in queries.p8_found(spark, tables).collect()}
    texts = {r.doc_id: r.text for r in table(spark, tables, "documents").collect()}
    assert {x.doc_id for x in rows if x.n_removed} <= found
    assert all(x.text == texts[x.doc_id] for x in rows if not x.n_removed)
    assert {d for d in texts if d not in {x.doc_id for x in rows}} <= found
    again = leaked_documents(left, table(spark, tables, "eval_items"))
    assert again.count() == 0


def test_p9_sentences_of_the_whole_table(spark, tables):
    import re as regex_

    from strataleaf.sources.tables import table

    docs, first, repeated = {}, {}, defaultdict(set)
    for r in sorted(table(spark, tables, "documents").collect(), key=lambda r: r.doc_id):
        parts = [x for m in regex_.finditer(r"[^.!?。\n]+[.!?。]*", r.text or "") if (x := m.group().strip())]
        if parts:
            docs[r.doc_id] = len(parts)
        for k in range(len(parts) - 2):
            if first.setdefault(tuple(parts[k : k + 3]), (r.doc_id, k)) != (r.doc_id, k):
                repeated[r.doc_id] |= set(range(k, k + 3))
    assert {tuple(x) for x in queries.p9_sentence_spans(spark, tables).collect()} == {(d, n, len(repeated[d])) for d, n in docs.items()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, tables, name):
    from tests.oracle import differences

    assert not differences(queries.QUERIES[name](spark, tables), queries.SQL[name], tables)
