"""Explicit schemas of all tables. Exact decimals travel as text beside decimal(38,18); JSON objects are maps or structs."""

from __future__ import annotations

from pyspark.sql.types import StructType

BBOX = "struct<page_no: int, l: double, t: double, r: double, b: double, coord_origin: string>"
SOURCE = f"struct<artifact_id: string, doc_id: string, version: string, page_no: int, element_id: string, bbox: {BBOX}, table_ref: string, cell_ref: string>"
GATE = "struct<gate: string, passed: boolean, reason: string>"

DDL = {
    "source_registry": "artifact_id string, doc_id string, title string, publisher string, doc_kind string, stage string, coalfield string, block string, classification string, source_url string, page_count int, registered_at timestamp",
    "document_ast": "doc_id string, artifact_id string, ast_path string, ast_hash string, element_count int, table_count int, created_at timestamp",
    "page_raster": "doc_id string, page_no int, dpi int, path string",
    "read_run": "run_id string, doc_id string, started_at timestamp, duration_s double, tier_counts map<string, bigint>",
    "candidate_fact": "candidate_id string, doc_id string, entity_raw string, entity_id string, metric_raw string, metric_key string, value_raw string, value_text string, value decimal(38,18), unit string, unit_source string, qualifiers map<string, string>, value_kind string, period string, status string, "
    f"source {SOURCE}, extraction_confidence double, domain_type string, domain_pack_version int, state string, confidence double, gate_results array<{GATE}>, failed_gate string, failure_reason string, assay_run_id string, reeval_count int, approver string",
    "assay_run": "run_id string, doc_id string, pack_version int, started_at timestamp, candidate_count bigint, state_counts map<string, bigint>, failure_counts map<string, bigint>",
    "fact": f"fact_id string, fact_identity string, entity_id string, metric_key string, qualifiers map<string, string>, value_kind string, value decimal(38,18), value_text string, unit string, period string, status string, valid_from timestamp, valid_to timestamp, system_from timestamp, system_to timestamp, supersedes string, source {SOURCE}, candidate_id string, approver string, confidence double, version int, last_seen timestamp",
    "published_statement": "statement_id string, fact_id string, doc_id string, metric_key string, entity_id string, period string, qualifiers map<string, string>, value_kind string, value decimal(38,18), value_text string, unit string",
    "graph_node": "node_id string, label string, graph string, props map<string, string>, doc_id string",
    "graph_edge": "src string, dst string, rel string, trust_layer string, props map<string, string>, fact_id string, domain_pack_version int, doc_id string",
    "chunk": "chunk_id string, doc_id string, parent_id string, level int, raw_text string, context_prefix string, indexed_text string, source struct<page_no: int, table_ref: string, cell_ref: string, element_id: string>, candidate_id string, classification string",
    "lineage_edge": "id long, from_kind string, from_id string, to_kind string, to_id string, activity string, agent string, run_id string, at timestamp",
    "review_queue": "doc_id string, page_no int, element_id string, reason string, bbox " + BBOX + ", created_at timestamp",
    "audit_log": "ts timestamp, subject string, tool string, allowed boolean, reason string",
    "sealed_package": "package_id string, content_hash string, principal_subject string, max_classification array<string>, intent string, n_members bigint, sealed_at timestamp",
    "package_member": "package_id string, kind string, member_id string, body string",
    "ast_page": "doc_id string, page_no int, text string, image_count int, width double, height double",
    "ast_text": f"doc_id string, element_id string, page_no int, pos int, text string, bbox {BBOX}, confidence double",
    "ast_table": f"doc_id string, element_id string, page_no int, num_rows int, num_cols int, bbox {BBOX}, tier int, confidence double",
    "ast_cell": f"doc_id string, element_id string, row int, col int, text string, column_header boolean, confidence double, footnotes array<string>, bbox {BBOX}",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
