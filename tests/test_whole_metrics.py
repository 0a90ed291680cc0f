"""The values in the contents themselves are parsed, of the row that was updated last."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataleaf.operators.extract import parse_metric
from strataleaf.plans import registry

T0 = datetime(2024, 1, 1)
LITERALS = [("₹7.5Cr", 7.5e7, "CURRENCY"), ("7%", 0.07, "PERCENTAGE"), ("7 million", 7e6, "NUMERIC"), ("N/A", 0.0, "UNKNOWN"), ("$7k", 7e3, "CURRENCY"), ("1,000", 0.0, "UNKNOWN"), ("7T", 7.0, "NUMERIC"), (" -7 ", -7.0, "NUMERIC")]


def test_literals(spark):
    rows = spark.createDataFrame([(x,) for x, _, _ in LITERALS], "x string").select("x", parse_metric(F.col("x")).alias("m"))
    assert {r.x: (pytest.approx(r.m.numeric_value), r.m.unit) for r in rows.collect()} == {x: (v, u) for x, v, u in LITERALS}


def test_contents(spark, tmp_path):
    v = [("v1", 1, "Revenue = 35%", 0), ("v2", 9, "Cost = $2k", 0), ("v2", 9, "Cost = $3k", 5), ("v2", 8, "Cost = $1k", 2), ("v3", 4, "no value", 0), ("v4", 7, None, 0)]
    rows = [(a, n, c, T0 + timedelta(hours=h)) for a, n, c, h in v]
    spark.createDataFrame(rows, "version_id string, version_number int, content string, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/node_versions.parquet")
    got = {tuple(r) for r in registry.QUERIES["fn01_content_metrics"](spark, str(tmp_path)).collect()}
    assert got == {("v1", 0.35, "PERCENTAGE"), ("v2", 3000.0, "CURRENCY"), ("v3", 0.0, "UNKNOWN"), ("v4", 0.0, "UNKNOWN")}


def test_texts(spark, tmp_path):
    spark.createDataFrame([(1, "Revenue was $5k in May. Margin is 12%"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.numeric_value, r.unit) for r in registry.QUERIES["fn01_text_metrics"](spark, str(tmp_path)).collect()}
    assert got == {(1, 5000.0, "CURRENCY"), (1, 0.12, "PERCENTAGE")}
