"""Queries of the text problems over the whole tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataleaf.llm import sql
from strataleaf.llm.encoding import encode_corpus
from strataleaf.llm.leakage import leaked_documents, without_leaks
from strataleaf.llm.nearcopies import near_copies
from strataleaf.llm.spans import sentence_spans, shared_chars, shared_spans
from strataleaf.llm.splitting import split_nodes
from strataleaf.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_nodes(table(spark, d, "apex_ast_nodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies(table(spark, d, "node_versions"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without its leaked passages."""
    return without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_chars(shared_spans(table(spark, d, "documents")))


def p9_sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    return sentence_spans(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p6_found, p7_ids, p8_found, p8_cleaned, p9_found, p9_sentence_spans)}
SQL: dict[str, str] = {**sql.SQL}
