"""Readers of the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions.ids import norm_id

# Fixed value: the columns that hold node ids.
NODE_IDS = {
    "apex_ast_nodes": ("node_id", "parent_id"), "apex_causal_edges": ("source_node_id", "target_node_id"),
    "node_versions": ("node_id",), "apex_temporal_metadata": ("node_id", "superseded_by"),
}


class SameIds(str):
    """A folder of tables whose node ids are read as all operators compare them; names of entities stay as written."""

    __slots__ = ()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` in ``folder``; columns are pruned and filters pushed down by the scan itself."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    if isinstance(folder, SameIds):
        same = lambda c: F.when(norm_id(c).startswith("entity:"), F.col(c)).otherwise(norm_id(c))
        return rows.withColumns({c: same(c) for c in NODE_IDS.get(name, ())})
    return rows
