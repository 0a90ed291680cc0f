"""Markdown to nodes, by windows over lines: no line's kind needs more state than a running count or last value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.session import materialise
from strataleaf.sources.chunks import greedy_chunks

# What makes a heading, a table row, a page marker and a fence.
HEADING, TABLE_ROW = r"^(#{1,6})\s+(.*)$", r"^\|.+\|$"
PAGE = r"(?i)^(?:<!--\s*Page\s+(\d+)\s*-->|\[Page\s+(\d+)\])"
FENCE = r"^`{3,}\s*\w*\s*$"
ROOT = "(implicit root)"


def parse_markdown(docs: DataFrame, max_chars: int = 3000) -> DataFrame:
    """Nodes of (doc_id, text): (doc_id, node_no, node_type, depth, parent_no, page_number, content).

    Headings nest by their level; what stands below a heading are its paragraphs (lines up to the next heading,
    table or fence, blank ones included), tables (without their separator rows) and fenced code. Page markers give
    the greatest page so far. A text without headings hangs under an implicit root, number 0. Nodes without
    children over ``max_chars`` pass their content to chunks of their paragraphs, numbered after all others.
    node_no is the line a node begins at, from 1. Null texts have no nodes; an unclosed fence stays text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)
    w = Window.partitionBy("doc_id").orderBy("no")
    whole = Window.partitionBy("doc_id")
    fence = F.rlike("line", F.lit(FENCE))
    lines = lines.withColumn("fences", F.count_if(fence).over(w)).withColumn("all_fences", F.count_if(fence).over(whole))
    closed = F.col("fences") <= F.col("all_fences") - F.col("all_fences") % 2
    in_code = closed & (fence | (F.col("fences") % 2 == 1))
    lines = lines.withColumn("code", in_code).withColumn("fence", fence & in_code)
    bare = F.trim("line")
    page = F.coalesce(F.nullif(F.regexp_extract("line", PAGE, 1), F.lit("")), F.nullif(F.regexp_extract("line", PAGE, 2), F.lit(""))).try_cast("int")
    row = F.rlike(bare, F.lit(TABLE_ROW))
    kind = (
        F.when(F.col("fence"), "FENCE").when(F.col("code"), "CODE").when(page.isNotNull(), "PAGE").when(F.rlike("line", F.lit(HEADING)), "HEADING")
        .when(row & F.contains(bare, F.lit("---")), "SEPARATOR").when(row, "TABLE").otherwise("PARAGRAPH")
    )
    lines = lines.withColumn("kind", kind).withColumn("page_number", F.max(F.when(kind == "PAGE", page)).over(w)).filter("kind <> 'PAGE'")
    level = F.when(F.col("kind") == "HEADING", F.length(F.regexp_extract("line", HEADING, 1)))
    lines = lines.withColumn("level", level)
    # a new block begins with a heading, a fence, or another kind; separator rows go with the table around them
    shown = F.when(F.col("kind") == "SEPARATOR", "TABLE").otherwise(F.col("kind"))
    lines = lines.withColumn("shown", shown)
    new = (F.col("shown").isin("HEADING", "FENCE")) | ~F.lag("shown").over(w).eqNullSafe(F.col("shown"))
    lines = lines.withColumn("block", F.count_if(new).over(w))
    above = F.coalesce(*[F.when(F.col("level") == k, F.last(F.when(F.col("level") < k, F.struct("no", "level")), ignorenulls=True).over(w)) for k in range(1, 7)])
    lines = lines.withColumn("above", F.when(F.col("kind") == "HEADING", above).otherwise(F.last(F.when(F.col("level").isNotNull(), F.struct("no", "level")), ignorenulls=True).over(w)))
    text = F.when(F.col("kind") == "HEADING", F.trim(F.regexp_extract("line", HEADING, 2))).when(F.col("kind") == "TABLE", bare).when(F.col("kind") != "SEPARATOR", F.col("line"))
    blocks = lines.filter("kind <> 'FENCE'").groupBy("doc_id", "block").agg(
        F.min("no").alias("node_no"), F.first("shown").alias("node_type"), F.max("page_number").alias("page_number"), F.max("level").alias("level"),
        F.min_by("above", "no").alias("above"), F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("no", text.alias("t"))))).alias("parts"),
    )
    content = F.array_join("parts.t", "\n")
    content = F.when(F.col("node_type") == "CODE", content).otherwise(F.regexp_replace(content, r"^\s+|\s+$", ""))
    blocks = blocks.withColumn("content", content).filter("content <> '' or node_type = 'CODE'")
    headed = F.max((F.col("node_type") == "HEADING").cast("int")).over(whole) == 1
    own_depth = F.when(F.col("node_type") == "HEADING", F.col("level") - 1).otherwise(F.coalesce(F.col("above.level"), F.lit(0)))
    nodes = blocks.select(
        "doc_id", "node_no", "node_type", own_depth.cast("int").alias("depth"), F.when(headed, F.col("above.no")).otherwise(F.lit(0)).alias("parent_no"),
        "page_number", "content", headed.alias("headed"),
    )
    root = nodes.filter("not headed").groupBy("doc_id").agg(F.max("page_number").alias("page_number")).select(
        "doc_id", F.lit(0).alias("node_no"), F.lit("HEADING").alias("node_type"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("parent_no"), "page_number", F.lit(ROOT).alias("content"))
    nodes = nodes.drop("headed").unionByName(root)
    return _with_chunks(nodes, max_chars)


def section_paths(docs: DataFrame, levels: int = 6) -> DataFrame:
    """Headings of (doc_id, text) with their dotted paths: (doc_id, node_no, content, path). A heading counts its place among those
    that share its parent; what stands below a heading without a title has no path. Paths grow level by level, so there are as
    many joins as levels."""
    h = parse_markdown(docs.select("doc_id", "text"), 1 << 30).filter("node_type = 'HEADING' and node_no > 0").select("doc_id", "node_no", "depth", "parent_no", "content")
    place = F.row_number().over(Window.partitionBy("doc_id", "parent_no").orderBy("node_no"))
    h = materialise(h.withColumn("place", place.cast("string")), "headings")
    done = h.filter("parent_no is null").select("doc_id", "node_no", "depth", "content", F.col("place").alias("path"))
    for level in range(1, levels):
        up = done.select("doc_id", F.col("node_no").alias("parent_no"), F.col("path").alias("up"))
        own = h.filter(F.col("depth") == level).join(up, ["doc_id", "parent_no"])
        done = done.unionByName(own.select("doc_id", "node_no", "depth", "content", F.concat_ws(".", "up", "place").alias("path")))
    return done.select("doc_id", "node_no", "content", "path")


def _with_chunks(nodes: DataFrame, max_chars: int) -> DataFrame:
    parents = nodes.filter("parent_no is not null").select("doc_id", F.col("parent_no").alias("node_no"), F.lit(True).alias("inner")).distinct()
    n = nodes.join(parents, ["doc_id", "node_no"], "left")
    parts = F.when(F.col("inner").isNull() & (F.length("content") > max_chars), greedy_chunks(F.col("content"), max_chars))
    n = n.withColumn("parts", F.when(F.size(parts) > 1, parts))
    w = Window.partitionBy("doc_id").orderBy("parent_no", "i")
    last = n.groupBy("doc_id").agg(F.max("node_no").alias("last"))
    chunks = n.filter("parts is not null").select(
        "doc_id", "node_type", (F.col("depth") + 1).alias("depth"), F.col("node_no").alias("parent_no"), "page_number", F.posexplode("parts").alias("i", "content")
    )
    chunks = chunks.join(last, "doc_id").withColumn("node_no", F.col("last") + F.row_number().over(w)).drop("i", "last")
    kept = n.withColumn("content", F.when(F.col("parts").isNotNull(), "").otherwise(F.col("content"))).drop("inner", "parts")
    return kept.unionByName(chunks).select("doc_id", "node_no", "node_type", "depth", "parent_no", "page_number", "content")
