"""Queries of the general data problems over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.operators.hierarchy import descendants, node_hierarchy
from strataleaf.operators.history import merged_by_year, scd2_merge, version_periods
from strataleaf.operators.intervals import version_spans
from strataleaf.operators.orphans import orphan_references, orphans_by_period
from strataleaf.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    dimension = scd2_merge(None, table(spark, d, "node_versions"))
    return dimension.filter("to_us is not null").select("version_id", F.col("eff").alias("from_us"), "to_us")


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same history, built by merging each year's rows into what is stored."""
    return merged_by_year(table(spark, d, "node_versions"))


def p1_current(spark: SparkSession, d: str) -> DataFrame:
    """The versions in force now, whatever the stored flags say."""
    periods = version_periods(table(spark, d, "node_versions"))
    return periods.filter("is_current").select("node_id", "version_id", F.col("from_us"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*(table(spark, d, t) for t in ("apex_ast_nodes", "node_versions", "apex_causal_edges", "apex_temporal_metadata")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return version_spans(table(spark, d, "node_versions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return node_hierarchy(table(spark, d, "apex_ast_nodes"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return node_hierarchy(table(spark, d, "apex_ast_nodes"), with_paths=True).select("node_id", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(node_hierarchy(table(spark, d, "apex_ast_nodes"), with_paths=True))


QUERIES = {f.__name__: f for f in (p1_found, p1_merged, p1_current, p2_found, p2_report, p3_found, p5_found, p5_paths, p5_descendants)}
