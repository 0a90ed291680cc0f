"""Files as rows: texts whole, anything else as bytes, with the kind their name tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds by extension; any other extension is read as text.
KINDS = {
    "md": "markdown", "markdown": "markdown", "txt": "markdown", "pdf": "pdf", "docx": "docx", "py": "python", "js": "javascript", "ts": "javascript", "rs": "rust", "cpp": "c++",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "webp": "image", "tiff": "image", "svg": "image",
}


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[ext], F.lit("markdown"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text), a row a file, read as bytes and taken as UTF-8. Empty files have no row, as a scan passes them over."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.col("content").cast("string").alias("text"), kind_of(F.col("path")).alias("kind"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content) of any files; images also as a data URI and a title from their name."""
    b = spark.read.format("binaryFile").load(path).select("path", kind_of(F.col("path")).alias("kind"), "length", "content")
    name = F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    image = F.col("kind") == "image"
    uri = F.concat(F.lit("data:image/"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit(";base64,"), F.base64("content"))
    return b.withColumn("title", F.when(image, F.initcap(F.translate(name, "_-", "  ")))).withColumn("data_uri", F.when(image, uri))
