"""Writes that keep their meaning when repeated: upserts, appends by tenant, cascaded deletes, exports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.ids import norm_id
from strataleaf.operators.hierarchy import hierarchy, latest_nodes


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with ``new`` rows in the place of those with their key; of several new rows the one with the
    greatest ``order`` (then the greatest values) counts. Columns in ``keep`` keep the stored value."""
    cols = [c for c in stored.columns if c != key]
    last = new.groupBy(key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("v")).select(key, *[F.col("v")[c].alias(c) for c in cols])
    old = stored.select(key, *[F.col(c).alias(f"__{c}") for c in keep], F.lit(True).alias("__old"))
    last = last.join(old, key, "left")
    for c in keep:
        last = last.withColumn(c, F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c)))
    return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(last.select(*stored.columns))


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with those rows of ``new`` whose keys it has not, one row a key. Null keys are keys like others."""
    fresh = new.dropDuplicates(keys)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    fresh = fresh.alias("n").join(stored.select(*keys).alias("o"), reduce(lambda a, b: a & b, same), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def append_log(rows: DataFrame, at: str, path: str) -> None:
    """Append rows of an event log, in folders by the day of ``at``."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def append_for_tenant(rows: DataFrame, tenant: str, path: str) -> None:
    """Append with the caller's tenant in the place of the rows' own; an empty tenant raises ValueError."""
    if not tenant.strip():
        raise ValueError("a tenant is required")
    rows.withColumn("tenant_id", F.lit(tenant)).write.mode("append").partitionBy("tenant_id").parquet(path)


def delete_documents(docs: DataFrame, nodes: DataFrame, edges: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (by source only) and metadata that stay when documents (doc_id) go."""
    gone = nodes.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("node_id").distinct()
    return (
        nodes.join(docs.select("doc_id").distinct(), "doc_id", "left_anti"),
        edges.join(gone.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_anti"),
        metadata.join(gone, "node_id", "left_anti"),
    )


def exported(nodes: DataFrame) -> DataFrame:
    """Trees as lines: (root_id, node_id, level_no, json), a row a node with its parent, type and content, whatever a tree's or a
    node's children's number. Of several rows of a node the latest counts; nodes that reach no root are under ``cycle``."""
    rows = latest_nodes(nodes, "node_id", "parent_id", "node_type", "content")
    at = hierarchy(rows.select("key", F.col("key").alias("name"), norm_id("parent_id").alias("parent")))
    at = at.select(F.col("node_id").alias("key"), F.col("root_id").alias("root"), "level_no")
    roots = rows.select(F.col("key").alias("root"), F.col("node_id").alias("root_id"))
    j = rows.join(at, "key").join(roots, "root", "left")
    line = F.to_json(F.struct("node_id", "parent_id", "node_type", "content"))
    return j.select(F.coalesce("root_id", F.lit("cycle")).alias("root_id"), "node_id", "level_no", line.alias("json"))


def write_files(rows: DataFrame, folder: str) -> None:
    """A file for each row (name, content) in ``folder``, which all executors see; null contents make empty files. Workers write their
    rows one by one, a repeated task replaces its own files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        fs.create_dir(at)
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                with fs.open_output_stream(f"{at}/{name}") as f:
                    f.write((content or "").encode())
            yield pd.DataFrame({"n": [len(b)]})

    rows.select("name", "content").mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()
