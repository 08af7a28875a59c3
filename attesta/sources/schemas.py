"""Record types of the files that are read and written, as DDL."""

from __future__ import annotations

CHUNK_LINE = (
    "text STRING, metadata STRUCT<type: STRING, credit_type: STRING, credit_code: STRING, credit_name: STRING, "
    "category: STRING, section: STRING, credit_id: STRING, chunk_id: STRING, source: STRING, doc: STRING, "
    "version: STRING, points_min: INT, points_max: INT, pages: ARRAY<INT>, page_start: INT, page_end: INT>"
)
CREDIT = (
    "category STRING, credit_code STRING, credit_name STRING, credit_type STRING, version STRING, rating_system STRING, "
    "intent STRING, requirements ARRAY<STRING>, options ARRAY<STRUCT<heading: STRING, lines: ARRAY<STRING>, points: INT>>, "
    "documentation ARRAY<STRING>, points_raw STRING, points_min INT, points_max INT, applicability ARRAY<STRING>, "
    "equations ARRAY<STRING>, calc_methods ARRAY<STRING>, related_credits ARRAY<STRING>, "
    "exemplary_performance ARRAY<STRING>, referenced_standards ARRAY<STRING>, step_by_step ARRAY<STRING>, "
    "guidance ARRAY<STRING>, sources STRUCT<pages: ARRAY<INT>, effective_date: STRING, version_date: STRING>, "
    "completeness_score DOUBLE, validation_errors ARRAY<STRING>, extraction_confidence DOUBLE"
)
BUILDING = (
    "building_name STRING, building_code STRING, square_footage BIGINT, construction_year BIGINT, building_type STRING, "
    "leed_status STRING, leed_version STRING, leed_level STRING, sustainability_features ARRAY<STRING>, "
    "energy_consumption BIGINT, water_consumption BIGINT"
)
EXTRACTION = (
    "source_file STRING, file_type STRING, extraction_timestamp STRING, "
    "metadata STRUCT<title: STRING, author: STRING, subject: STRING, page_count: INT, file_size: BIGINT, ocr_pages: INT>, "
    "text_content ARRAY<STRUCT<page: INT, text: STRING, total_chars: INT, ocr_used: BOOLEAN>>, "
    "tables ARRAY<STRUCT<page: INT, table_index: INT, rows: INT, columns: INT, data: ARRAY<ARRAY<STRING>>>>, "
    "sheets ARRAY<STRUCT<name: STRING, rows: ARRAY<MAP<STRING, STRING>>>>, content STRING, error STRING"
)
