"""Schemas (DDL) of the stored tables; nested parts are native types, not JSON text."""

from __future__ import annotations

TABLE = (
    "STRUCT<id: INT, sheet_name: STRING, row_count: INT, column_count: INT, confidence: DOUBLE, "
    "headers: ARRAY<STRING>, data_rows: ARRAY<ARRAY<STRING>>>"
)
ENTITY = (
    "STRUCT<text: STRING, category: STRING, subcategory: STRING, confidence: DOUBLE, "
    "normalized: STRING>"
)
CONFIDENCE = (
    "STRUCT<overall: DOUBLE, text_extraction: DOUBLE, table_detection: DOUBLE, "
    "entity_recognition: DOUBLE, quality_assessment: STRING>"
)

CASES = (
    "case_id STRING, year INT, seq INT, title STRING, base_path STRING, status STRING, "
    "notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
DOCUMENTS = (
    "document_id STRING, case_id STRING, filename STRING, filepath STRING, file_hash STRING, "
    "mime_type STRING, size_bytes BIGINT, page_count INT, language STRING, ocr_success BOOLEAN, "
    "created_at TIMESTAMP"
)
OCR_RESULTS = (
    "document_id STRING, file_hash STRING, engine STRING, engine_version STRING, raw_text STRING, "
    f"key_value_pairs MAP<STRING, STRING>, tables ARRAY<{TABLE}>, entities ARRAY<{ENTITY}>, "
    f"confidence {CONFIDENCE}, metadata MAP<STRING, STRING>, errors ARRAY<STRING>, "
    "processed_at TIMESTAMP"
)
EXTRACTED_DATA = (
    "document_id STRING, document_type STRING, entities MAP<STRING, ARRAY<STRING>>, "
    "key_value_pairs MAP<STRING, STRING>, extra MAP<STRING, STRING>, written_at TIMESTAMP"
)
RUNS = (
    "run_id STRING, case_id STRING, purpose STRING, params MAP<STRING, STRING>, "
    "created_at TIMESTAMP"
)
AI_ANALYSES = (
    "analysis_id STRING, case_id STRING, document_id STRING, model STRING, temperature DOUBLE, "
    "content_analysis STRING, visual_analysis STRING, contextual_analysis STRING, "
    "alerts ARRAY<STRUCT<type: STRING, severity: STRING, description: STRING>>, "
    "created_at TIMESTAMP"
)
FEEDBACK = (
    "case_id STRING, field STRING, original_value STRING, corrected_value STRING, status STRING, "
    "created_at TIMESTAMP"
)
CACHE_STATS = (
    "scope STRING, ocr_hits BIGINT, ocr_misses BIGINT, extract_hits BIGINT, "
    "extract_misses BIGINT, ms_saved BIGINT, bytes_saved BIGINT"
)
PROGRESS_EVENTS = (
    "case_id STRING, event_id BIGINT, stage STRING, status STRING, ts TIMESTAMP, "
    "doc_index INT, doc_total INT, message STRING"
)
STORED_TABLES = {
    "cases": CASES,
    "documents": DOCUMENTS,
    "ocr_results": OCR_RESULTS,
    "extracted_data": EXTRACTED_DATA,
    "runs": RUNS,
    "ai_analyses": AI_ANALYSES,
    "feedback": FEEDBACK,
    "cache_stats": CACHE_STATS,
}
