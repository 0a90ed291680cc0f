"""DOCX and PDF files to blocks of text, with what the standard library offers."""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLOCKS = "path string, block_no long, node_type string, level int, page_number int, content string"


def docx_blocks(content: bytes) -> list[tuple[str, int | None, int | None, str]]:
    """(node_type, level, page, text) of the paragraphs and tables of a DOCX file: paragraphs with a style named Heading n are headings of
    that level, a table's cells are joined by `` | `` and its rows by line ends; empty ones are left out."""
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, int | None, int | None, str]] = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"(?i)heading\s*([1-9])", style.get(f"{_W}val", "") if style is not None else "")
            kind = "HEADING" if level else "PARAGRAPH"
            out.append((kind, int(level[1]) if level else None, None, text(e).strip()))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(text(c).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            out.append(("TABLE", None, None, "\n".join(rows)))
    return [b for b in out if b[3]]


_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _shown(stream: bytes) -> str:
    """The strings that a page's content shows, a line for each line that it moves to."""
    lines = [b""]
    for op in re.finditer(rb"(\[(?:\\.|[^\]\\])*\]\s*TJ)|(\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\"))|\b(T\*|Td|TD|ET)\b", stream):
        if op[3]:
            lines.append(b"")
            continue
        for s in _STRING.findall(op[0]):
            lines[-1] += re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda m: _ESCAPES.get(m[1], m[1] if not m[1].isdigit() else bytes([int(m[1], 8) & 255])), s[1:-1])
    return "\n".join(x.decode("latin-1").strip() for x in lines if x.strip())


def pdf_blocks(content: bytes) -> list[tuple[str, int | None, int | None, str]]:
    """(PARAGRAPH, None, page, text) of the pages of a simple PDF file: content streams, plain or deflated, in their order in the
    file, with text in single-byte encodings. Encrypted files and fonts with their own encodings give no readable text."""
    out: list[tuple[str, int | None, int | None, str]] = []
    for m in re.finditer(rb"<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>\s*stream\r?\n(.*?)endstream", content, re.DOTALL):
        data = m[1]
        if b"FlateDecode" in m[0][: m.start(1) - m.start()]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        text = _shown(data) if b"Tj" in data or b"TJ" in data else ""
        if text:
            out.append(("PARAGRAPH", None, len(out) + 1, text))
    return out


def parse_office(files: DataFrame) -> DataFrame:
    """(path, block_no, node_type, level, page_number, content) of (path, kind, content), kind being ``docx`` or ``pdf``; others have no
    rows. A file that can't be read gives one row of type ERROR with the message, null content none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = {"docx": docx_blocks, "pdf": pdf_blocks}
        for b in batches:
            rows = []
            for path, kind, content in zip(b["path"], b["kind"], b["content"], strict=True):
                if kind not in read or content is None:
                    continue
                try:
                    found = read[kind](bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    found = [("ERROR", None, None, str(e) or type(e).__name__)]
                rows += [(path, i, *x) for i, x in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["path", "block_no", "node_type", "level", "page_number", "content"]).astype({"level": "Int32", "page_number": "Int32"})

    return files.select("path", "kind", "content").mapInPandas(run, _BLOCKS)
