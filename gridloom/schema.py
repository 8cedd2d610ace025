"""Schemas of the tables that operators pass on."""

from __future__ import annotations

NUMERIC_INDEX = "section_id BIGINT, table_id BIGINT, row_idx INT, col_idx INT, numeric_value DOUBLE"
HEADINGS = "heading_id BIGINT, level INT"
TEXT_ELEMENTS = "page_id BIGINT, seq INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
PHYSICAL_ROWS = "table_id STRING, row_pos INT, row_type STRING, cells ARRAY<STRUCT<raw_text STRING, numeric_value DOUBLE>>"
TABLE_TRUTH = "table_id STRING, source_file STRING, source_page INT, row_count INT, col_count INT, columns ARRAY<STRUCT<name STRING, dtype STRING, unit STRING, nullable BOOLEAN, is_critical BOOLEAN>>"
CELLS = "table_id STRING, row_pos INT, row_idx INT, col_pos INT, col_idx INT, tag STRING, i BIGINT, f DOUBLE, s STRING, d DATE, confidence FLOAT, source_text STRING, encoding_status STRING, encoding_evidence STRING, global_id STRING"
RULES = "rule_ord INT, rule_type STRING, src_table STRING, src_row INT, src_col INT, tgt_table STRING, tgt_row INT, tgt_col INT"
RELATIONS = "rel_ord INT, from_id STRING, to_id STRING, kind STRING, metadata STRING"
DOCUMENT_SUMMARY = "id STRING, source_path STRING, total_pages INT, has_ocr BOOLEAN, markdown STRING, error_code STRING"
DELTAS = "pass INT, kind STRING, section_id BIGINT, table_id BIGINT, row_idx INT, col_idx INT, heading_id BIGINT, old_value DOUBLE, new_value DOUBLE, delta DOUBLE, old_level INT, new_level INT"

#: Closed value sets of string columns.
ROW_TYPES = ("Header", "Data", "Total", "Description")
DATA_TYPES = ("Int", "Float64", "Utf8", "Date")
ENCODING_STATUSES = ("Clean", "Suspicious", "Invalid")
RELATION_KINDS = ("PARENT_OF", "APPENDIX_TO", "VERIFIED_BY", "REFERENCE")
