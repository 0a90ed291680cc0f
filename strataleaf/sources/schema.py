"""The engine's own tables: their columns, and how a folder of empty ones is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the stored tables.
TABLES = {
    "apex_ast_nodes": "node_id string, content string, node_type string, depth int, parent_id string, doc_id string, tenant_id string, source_date timestamp_ntz, ingestion_date timestamp_ntz, page_number int, embedding array<double>",
    "node_versions": "version_id string, node_id string, content string, content_hash string, created_at timestamp_ntz, updated_at timestamp_ntz, effective_from timestamp_ntz, effective_to timestamp_ntz, version_number int, is_current boolean, previous_version string, validity_status string, doc_id string, tenant_id string",
    "apex_causal_edges": "edge_id string, source_node_id string, target_node_id string, edge_type string, strength double, evidence string, projections array<string>, metadata string, discovered_at timestamp_ntz",
    "apex_temporal_metadata": "node_id string, source_date timestamp_ntz, ingestion_date timestamp_ntz, freshness_score double, decay_rate double, superseded_by string, updated_at timestamp_ntz, effective_from timestamp_ntz, effective_to timestamp_ntz, version_number int, is_current boolean, validity_status string",
    "temporal_facts": "fact_id string, tenant_id string, subject string, predicate string, object string, confidence double, source_document_id string, source_node_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, created_at timestamp_ntz, parent_fact_id string, superseded_by string, extraction_method string, metadata string",
    "fact_extraction_jobs": "job_id string, doc_id string, tenant_id string, dedup_key string, status string, retry_count int, max_retries int, error_message string, facts_extracted bigint, created_at timestamp_ntz, updated_at timestamp_ntz, completed_at timestamp_ntz, node_count int",
    "page_index": "node_id string, doc_id string, term string, page_number int, tenant_id string",
    "timeline_events": "entity_id string, event_type string, event_date timestamp_ntz, description string, value double",
    "change_history": "id string, entity_id string, entity_type string, changed_by string, changed_at timestamp_ntz, field_name string, old_value string, new_value string",
    "state_snapshots": "snapshot_id string, doc_id string, snapshot_date timestamp_ntz, snapshot_data string",
    "audit_logs": "audit_id string, query string, doc_id string, created_at timestamp_ntz, payload string",
}


def create(spark: SparkSession, folder: str) -> list[str]:
    """Make the tables that ``folder`` lacks, empty; the names of those made. Existing ones stay as they are."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    made = []
    for name, columns in TABLES.items():
        path = f"{folder}/{name}.parquet"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            spark.createDataFrame([], columns).write.parquet(path)
            made.append(name)
    return made


def columns_of(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """(table_name, column_name, position) as the tables in ``folder`` have them."""
    rows = [(n, c, i) for n in names for i, c in enumerate(spark.read.parquet(f"{folder}/{n}.parquet").columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")
