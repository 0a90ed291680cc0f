"""Source code to symbols and nodes."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Symbols by language: kind, pattern, the groups of name and base (0: none).
SYMBOLS = {
    "python": [("function", r"(?m)^\s*def\s+(\w+)\s*\(", 1, 0), ("class", r"(?m)^\s*class\s+(\w+)(?:\((\w+)\))?:", 1, 2)],
    "javascript": [("function", r"(?m)function\s+(\w+)", 1, 0), ("function", r"(?m)const\s+(\w+)\s*=\s*\(.*?\)\s*=>", 1, 0), ("class", r"(?m)^\s*class\s+(\w+)(?:\s+extends\s+(\w+))?", 1, 2)],
    "rust": [("function", r"(?m)^\s*(?:pub\s+)?fn\s+(\w+)\s*\(", 1, 0), ("struct", r"(?m)^\s*(?:pub\s+)?struct\s+(\w+)", 1, 0)],
    "c++": [("function", r"(?m)^\s*[\w:]+\s+(\w+)\s*\(.*?\)\s*(?:const)?\s*\{", 1, 0)],
}


def symbols(files: DataFrame) -> DataFrame:
    """(path, symbol_no, kind, name, base) of (path, language, code); unknown languages and null codes have none."""
    parts = []
    for language, patterns in SYMBOLS.items():
        own = files.filter(F.col("language") == language)
        for k, (kind, pattern, name, base) in enumerate(patterns):
            get = lambda g, p=pattern: F.regexp_extract_all("code", F.lit(p), F.lit(g))
            bases = get(base) if base else F.transform(get(name), lambda x: F.lit(""))
            rows = own.select("path", F.lit(k).alias("rank"), F.lit(kind).alias("kind"), F.posexplode(F.arrays_zip(get(name).alias("n"), bases.alias("b"))).alias("i", "s"))
            parts.append(rows.select("path", "rank", "i", "kind", F.col("s.n").alias("name"), F.nullif(F.col("s.b"), F.lit("")).alias("base")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("symbol_no", F.row_number().over(Window.partitionBy("path").orderBy("rank", "i"))).select("path", "symbol_no", "kind", "name", "base")


def symbol_edges(found: DataFrame) -> DataFrame:
    """Inheritance (DEPENDS_ON, 0.9) within a file and neighbouring symbols (SUCCESSOR, 0.7)."""
    base = found.select("path", F.col("name").alias("base"), F.col("symbol_no").alias("target"))
    up = found.filter("base is not null").select("path", "base", F.col("symbol_no").alias("source")).join(base, ["path", "base"])
    up = up.select("path", "source", "target", F.lit("DEPENDS_ON").alias("edge_type"), F.lit(0.9).alias("strength"))
    nxt = found.select("path", F.col("symbol_no").alias("source"), F.lead("symbol_no").over(Window.partitionBy("path").orderBy("symbol_no")).alias("target"))
    return up.unionByName(nxt.filter("target is not null").select("path", "source", "target", F.lit("SUCCESSOR").alias("edge_type"), F.lit(0.7).alias("strength")))


def _definitions(tree: ast.AST, parent: int | None, depth: int, out: list[tuple]) -> None:
    for node in ast.iter_child_nodes(tree):
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        if isinstance(node, ast.ClassDef):
            head = f"class {node.name}:"
        else:
            names = [a.arg for a in node.args.args] + [f"*{a.arg}" for a in node.args.kwonlyargs]
            head = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({', '.join(names)}):"
        doc = ast.get_docstring(node, clean=False)
        number = len(out) + 1
        out.append((number, "HEADING" if isinstance(node, ast.ClassDef) else "CODE", depth, parent, head + (f'\n    """{doc}"""' if doc is not None else "")))
        if isinstance(node, ast.ClassDef):
            _definitions(node, number, depth + 1, out)


def parse_python(files: DataFrame) -> DataFrame:
    """(path, node_no, node_type, depth, parent_no, content) of (path, code): classes with their methods, and
    functions. Code that doesn't parse gives one row of type ERROR with the message; null code none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, code in zip(b["path"], b["code"], strict=True):
                found: list[tuple] = []
                try:
                    _definitions(ast.parse(code), None, 0, found)
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    found = [(1, "ERROR", 0, None, str(e))]
                rows += [(path, *x) for x in found]
            yield pd.DataFrame(rows, columns=["path", "node_no", "node_type", "depth", "parent_no", "content"]).astype({"parent_no": "Int64"})

    return files.select("path", "code").filter("code is not null").mapInPandas(run, "path string, node_no long, node_type string, depth int, parent_no long, content string")
