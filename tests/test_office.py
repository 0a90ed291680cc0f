"""DOCX and PDF files made by hand, plug-ins, and the learned router on held-out texts."""

import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from strataleaf.functions.plugins import Plugins
from strataleaf.operators import learned, routes
from strataleaf.sources.office import parse_office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {W}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_office(spark):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Title é", "Heading1") + p("Body ") + p("") + p("Sub", "heading 2") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('c')}</w:tc></w:tr></w:tbl>"
    page = zlib.compress(rb"BT /F1 12 Tf (Hello \(you\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >> stream\n" + page + b"\nendstream endobj\n2 0 obj << /Length 3 >>\nstream\nBT (Second\\040page) Tj ET\nendstream\n"
    rows = [("a.docx", "docx", docx(body)), ("b.pdf", "pdf", pdf), ("c.docx", "docx", b"no zip"), ("d.docx", "docx", None), ("e.txt", "markdown", b"x"), ("f.pdf", "pdf", b"")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, kind string, content binary, `level` int")
    got = {(x.path, x.block_no): (x.node_type, x.level, x.page_number, x.content) for x in parse_office(df).collect()}
    assert got.pop(("c.docx", 1))[0] == "ERROR"
    assert got == {
        ("a.docx", 1): ("HEADING", 1, None, "Title é"), ("a.docx", 2): ("PARAGRAPH", None, None, "Body"), ("a.docx", 3): ("HEADING", 2, None, "Sub"),
        ("a.docx", 4): ("TABLE", None, None, "a | b\nc"), ("b.pdf", 1): ("PARAGRAPH", None, 1, "Hello (you)\nWorld"), ("b.pdf", 2): ("PARAGRAPH", None, 2, "Second page"),
    }


def test_plugins():
    p = Plugins()
    p.register("parser", "x", lambda a: a + 1)
    p.register("parser", "x", lambda a: a + 2)
    assert p.names("parser") == ["x"] and p.call("parser", "x", 1) == 3
    with pytest.raises(KeyError):
        p.call("agent", "x")
    with pytest.raises(ValueError):
        p.register("nothing", "x", print)


def test_learned_router_on_held_out_texts(spark):
    r = random.Random(6)
    told = {"entity": ["who", "company", "stakeholder"], "citation": ["reference", "footnote", "cited"], "policy": ["policy", "must", "compliance"]}
    plain = "what is the amount of revenue for last quarter in the northern region and how does it look today".split()
    rows = []
    for _ in range(900):
        w = r.sample(plain, 8) + [r.choice(v) for v in told.values() if r.random() < 0.4]
        r.shuffle(w)
        rows.append((" ".join(w),))
    df = spark.createDataFrame([*rows, (None,), ("",)], "text string")
    labelled = df.select("text", *[c.alias(k) for k, c in routes.projections(F.col("text")).items()])
    train, held = labelled.filter("xxhash64(text) % 3 <> 0"), labelled.filter("coalesce(xxhash64(text) % 3 = 0, true)")
    out = learned.route(learned.fit(train, list(told)), held, list(told)).collect()
    assert len(out) > 200
    for k in told:
        assert sum(x[k] == x[f"is_{k}"] for x in out) / len(out) > 0.95
    assert not any(x[f"is_{k}"] for x in out if x.text is None for k in told)
