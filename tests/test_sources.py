"""Parsers and sinks on small inputs."""

from strataleaf.operators import extract as X
from strataleaf.operators import sinks
from strataleaf.operators.policy import Rule, condition
from strataleaf.sources.chunks import greedy_chunks
from strataleaf.sources.code import parse_python, symbol_edges, symbols
from strataleaf.sources.files import read_binary, read_texts
from strataleaf.sources.markdown import parse_markdown

MD = """Intro line

# Report
First.

Second.
## Part
| a | b |
|---|---|
| 1 | 2 |
After table.
<!-- Page 3 -->
```py
# not a heading
x = 1
```
# Next
Tail."""


def test_markdown(spark):
    df = spark.createDataFrame([(1, MD), (2, "plain only"), (3, None), (4, "# H\n" + "\n\n".join(["p" * 900] * 5)), (5, "```\nopen # x")], "doc_id long, text string")
    rows = sorted(parse_markdown(df).collect(), key=lambda r: (r.doc_id, r.node_no))
    got = [(r.node_no, r.node_type, r.depth, r.parent_no, r.page_number, r.content) for r in rows if r.doc_id == 1]
    assert got == [
        (1, "PARAGRAPH", 0, None, None, "Intro line"), (3, "HEADING", 0, None, None, "Report"), (4, "PARAGRAPH", 1, 3, None, "First.\n\nSecond."),
        (7, "HEADING", 1, 3, None, "Part"), (8, "TABLE", 2, 7, None, "| a | b |\n| 1 | 2 |"), (11, "PARAGRAPH", 2, 7, None, "After table."),
        (14, "CODE", 2, 7, 3, "# not a heading\nx = 1"), (17, "HEADING", 0, None, 3, "Next"), (18, "PARAGRAPH", 1, 17, 3, "Tail."),
    ]
    assert [(r.node_no, r.content) for r in rows if r.doc_id == 2] == [(0, "(implicit root)"), (1, "plain only")]
    assert not [r for r in rows if r.doc_id == 3]
    four = [(r.node_type, r.parent_no, len(r.content)) for r in rows if r.doc_id == 4]
    assert four == [("HEADING", None, 1), ("PARAGRAPH", 1, 0), ("PARAGRAPH", 2, 2704), ("PARAGRAPH", 2, 1802)]
    assert [r.content for r in rows if r.doc_id == 5] == ["(implicit root)", "```\nopen # x"]


def test_greedy_chunks(spark):
    df = spark.createDataFrame([("aa\n\nbb\n\ncccccc\n\nd",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(greedy_chunks(df.t, 4)).collect()] == [["aa\n\nbb", "cccccc", "d"], None, [""]]


def test_code(spark):
    code = "class A:\n    'doc'\n    def f(self, *, k): pass\nclass B(A):\n    async def g(self): pass\ndef h(): pass\n"
    df = spark.createDataFrame([("p", "python", code), ("bad", "python", "def ("), ("n", "python", None), ("r", "rust", "pub fn go(x) {}\nstruct S")], "path string, language string, code string")
    got = {(r.path, r.kind, r.name, r.base) for r in symbols(df).collect()}
    assert {("p", "class", "B", "A"), ("p", "function", "h", None), ("r", "function", "go", None), ("r", "struct", "S", None)} <= got
    edges = {(r.path, r.edge_type, r.source, r.target) for r in symbol_edges(symbols(df)).collect()}
    assert ("p", "DEPENDS_ON", 4, 3) in edges and ("p", "SUCCESSOR", 1, 2) in edges
    nodes = [(r.node_no, r.node_type, r.depth, r.parent_no, r.content) for r in parse_python(df.filter("path = 'p'")).collect()]
    assert nodes[0] == (1, "HEADING", 0, None, 'class A:\n    """doc"""') and nodes[1] == (2, "CODE", 1, 1, "def f(self, *k):")
    assert [r.node_type for r in parse_python(df.filter("path = 'bad'")).collect()] == ["ERROR"]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nb")
    (tmp_path / "my_pic.png").write_bytes(b"\x89PNG")
    assert [(r.kind, r.text) for r in read_texts(spark, str(tmp_path / "a.md")).collect()] == [("markdown", "# A\nb")]
    (r,) = read_binary(spark, str(tmp_path / "*.png")).collect()
    assert (r.kind, r.title, r.data_uri) == ("image", "My Pic", "data:image/png;base64,iVBORw==")


def test_sinks(spark, tmp_path):
    kind = "node_id string, doc_id string, at int, parent_id string, node_type string, content string"
    old = spark.createDataFrame([("a", "d1", 1, None, "H", "x"), ("b", "d1", 1, "a", "P", "y")], kind)
    new = spark.createDataFrame([("b", "d2", 2, "a", "P", "z"), ("b", "d2", 3, "a", "P", "zz"), ("c", "d2", 1, "a", "P", "w")], kind)
    got = {(r.node_id, r.doc_id, r.content) for r in sinks.upsert(old, new, "node_id", "at", ("doc_id",)).collect()}
    assert got == {("a", "d1", "x"), ("b", "d1", "zz"), ("c", "d2", "w")}
    sinks.append_for_tenant(old, "t1", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("tenant_id = 't1'").count() == 2
    edges = spark.createDataFrame([("a", "z"), ("z", "a")], "source_node_id string, target_node_id string")
    n, e, m = sinks.delete_documents(spark.createDataFrame([("d1",)], "doc_id string"), old, edges, old.select("node_id"))
    assert (n.count(), [tuple(r) for r in e.collect()], m.count()) == (0, [("z", "a")], 0)
    rows = old.selectExpr("*", "timestamp_seconds(at) ingestion_date")
    lines = {r.node_id: (r.root_id, r.level_no, r.json) for r in sinks.exported(rows).collect()}
    assert lines["b"][:2] == ("a", 1) and '"parent_id":"a"' in lines["b"][2] and lines["a"][:2] == ("a", 0)
    assert sinks.exported(rows.limit(0)).count() == 0
    sinks.write_files(spark.createDataFrame([("x.md", "é"), ("y.py", None)], "name string, content string"), str(tmp_path / "files"))
    assert (tmp_path / "files/x.md").read_text() == "é" and (tmp_path / "files/y.py").read_text() == ""
    once = sinks.insert_new(old.select("node_id"), spark.createDataFrame([("a",), ("q",), ("q",), (None,)], "node_id string"), ["node_id"])
    assert sorted(r[0] or "" for r in once.collect()) == ["", "a", "b", "q"]


def test_metric_literals(spark):
    cases = {
        "$100": (100.0, "CURRENCY", 1.0), "$100k": (1e5, "CURRENCY", 1.0), "2.5M": (2.5e6, "NUMERIC", 1.0), "₹10L": (1e6, "CURRENCY", 1.0), "₹2Cr": (2e7, "CURRENCY", 1.0),
        "35%": (0.35, "PERCENTAGE", 1.0), "-5%": (-0.05, "PERCENTAGE", 1.0), "": (0.0, "UNKNOWN", 0.0), "N/A": (0.0, "UNKNOWN", 0.0), "5 million": (5e6, "NUMERIC", 1.0),
        "1,000": (0.0, "UNKNOWN", 0.0), "5T": (5.0, "NUMERIC", 1.0), "1e5": (1e5, "NUMERIC", 0.9), "$5L": (5.0, "CURRENCY", 1.0), "42": (42.0, "NUMERIC", 1.0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: tuple(r.m) for r in df.select("v", X.parse_metric(df.v).alias("m")).collect()}
    assert {k: (round(a, 9), b, c) for k, (a, b, c) in got.items()} == {k: (round(a, 9), b, c) for k, (a, b, c) in cases.items()}


def test_patterns_against_python(spark):
    import re

    text = "Dr. Jane Smith and Élodie Martin met on 2024-05-06, see Section 2.1; (Smith et al., 2020). GDPR and ISO 9001; from 2020 to 2021-01-01. On 3 May 2021 Revenue rose 5.5% to $1,000.50 in q3."
    text += "\nThe Vendor shall deliver the goods on time\nNext line here\nThe Agent is responsible for the goods delivered.\nPayment: net thirty days\nOther\r\nTerm = two years\r\nMegaSuite and DataEngine 5\u00a0k"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    for kind, (pattern, a, b) in X.PATTERNS.items():
        got = [(r.subject, r.object) for r in sorted(X.matches(df, "k", "t", kind).collect(), key=lambda r: r.match_no)]
        assert got == [(m.group(a), m.group(b)) for m in re.finditer(pattern, text)], kind


def test_rules(spark):
    df = spark.createDataFrame([(1, "ab", 5.0), (2, None, None)], "i int, s string, v double")
    hit = lambda rules, match="ALL": [r.i for r in df.filter(condition(rules, match)).collect()]
    assert hit([]) == [1, 2]
    assert hit([Rule("s", "STARTS_WITH", "a"), Rule("v", "GT", 4)]) == [1]
    assert hit([Rule("s", "EQ", "zz"), Rule("v", "NE", 5.0)], "ANY") == [2]
