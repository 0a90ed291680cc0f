"""Oddly written node ids join like those they stand for."""

from datetime import datetime

from strataleaf.plans import registry

T0 = datetime(2024, 1, 1)


def test_oddly_written_references(spark, tmp_path):
    nodes = [("n1", None, "d"), (" N2", " N1 ", "d"), ("n3", "n1", "d"), ("n4", " ", "d")]
    e = [("e1", " N1", "n2", "REFERENCES"), ("e2", "N2 ", " n3", "REFERENCES"), ("e3", " ", "n1", "REFERENCES"), ("e4", "N3", "entity:Bank", "MENTIONS")]
    spark.createDataFrame([(a, p, c, "t", "text", "TEXT", 0) for a, p, c in nodes], "node_id string, parent_id string, doc_id string, tenant_id string, content string, node_type string, depth int").write.parquet(f"{tmp_path}/apex_ast_nodes.parquet")
    spark.createDataFrame([(i, s, t, k, 0.5, ["citation"], T0) for i, s, t, k in e], "edge_id string, source_node_id string, target_node_id string, edge_type string, strength double, projections array<string>, discovered_at timestamp_ntz").write.parquet(f"{tmp_path}/apex_causal_edges.parquet")
    rows = lambda name: {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("joi03_all_edges_same_ids") == {("e1", "d", "t"), ("e2", "d", "t"), ("e4", "d", "t")} and rows("joi03_all_edges") == set()
    assert rows("src14_leaf_flags_same_ids") == {("n1", False), ("n2", True), ("n3", True), ("n4", True)}
    assert rows("gen13_structural_edges_same_ids") == {("n1", "n2", "REFINES"), ("n1", "n3", "REFINES"), ("n2", "n3", "SUPPORTS")}
    assert rows("grf05_dependencies_same_ids") == {("n1", "n2", 1), ("n2", "n3", 1), ("n1", "n3", 2)}
    assert rows("grf02_hops_to_entities_same_ids") == {("entity:Bank", 3)}
