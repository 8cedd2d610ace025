"""Checks of ingestion records in JSON, and pages of which some could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the records may say; fixed values.
DOCUMENT_TYPES = ("BOQ_RAW", "CONTRACT_RAW", "INVOICE_METADATA", "ACCEPTANCE_LOG_RAW", "ADJUSTMENT_ADDENDUM", "DRAWING_METADATA")
CONTENT_TYPES = ("table", "text", "image", "mixed")
ENGINES = ("calamine", "pdf_extract", "ocr_tesseract")
WARNING_CODES = ("LOW_CONFIDENCE", "MISSING_HEADER", "INCONSISTENT_COLUMNS", "UNRECOGNIZED_FORMAT")
RECORD = (
    "source STRING, document_type STRING, schema_version STRING, checksum STRING, origin_signature STRING, "
    "pages ARRAY<STRUCT<page INT, content_type STRING, confidence DOUBLE, table_rows INT, table_columns INT>>, "
    "extraction_meta STRUCT<engine STRING, engine_version STRING, timestamp STRING>, "
    "validation_warnings ARRAY<STRUCT<code STRING, message STRING, page INT>>"
)
_RECORD = "ingestion_record__"
REQUIRED = ("source", "document_type", "schema_version", "checksum", "origin_signature", "extraction_meta")


def _page_is_odd(p: Column) -> Column:
    fine = (p["page"] >= 1) & p["content_type"].isin(*CONTENT_TYPES) & F.coalesce(p["confidence"].between(0, 1), F.lit(True)) & (F.coalesce(p["table_rows"], F.lit(0)) >= 0) & (F.coalesce(p["table_columns"], F.lit(0)) >= 0)
    return ~F.coalesce(fine, F.lit(False))


def _warning_is_odd(w: Column) -> Column:
    return ~F.coalesce(w["code"].isin(*WARNING_CODES) & w["message"].isNotNull() & (F.coalesce(w["page"], F.lit(1)) >= 1), F.lit(False))


def validate_records(records: DataFrame, json: str = "json", source: str | None = None, schema_version: str | None = None) -> DataFrame:
    """The records with ``rejections``, the names of the parts that break the contract; empty if none does.

    A text that is no JSON object breaks ``record`` alone.  ``source`` and ``schema_version`` are what
    the fields of these names must say, if anything.  Records are checked row by row: nothing moves.
    """
    r = F.from_json(F.col(json), RECORD, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.col(json).rlike(r"^\s*\{") & F.get_json_object(F.col(json), "$").isNotNull(), F.lit(False))
    meta = F.col(f"{_RECORD}.extraction_meta")
    checks = {
        **{f"{name} missing": F.col(f"{_RECORD}.{name}").isNull() for name in REQUIRED},
        "source": F.lit(False) if source is None else F.col(f"{_RECORD}.source") != source,
        "document_type": ~F.col(f"{_RECORD}.document_type").isin(*DOCUMENT_TYPES),
        "schema_version": F.lit(False) if schema_version is None else F.col(f"{_RECORD}.schema_version") != schema_version,
        "checksum": ~F.col(f"{_RECORD}.checksum").rlike(r"^sha256:[a-f0-9]{64}\z"),
        "origin_signature": ~F.col(f"{_RECORD}.origin_signature").rlike(r"^ed25519:[a-f0-9]{128}\z"),
        "engine": ~F.coalesce(meta["engine"].isin(*ENGINES), meta.isNull()),
        "engine_version": ~F.coalesce(meta["engine_version"].rlike(r"^\d+\.\d+(\.\d+)?\z"), meta.isNull()),
        "timestamp": meta.isNotNull() & meta["timestamp"].try_cast("timestamp").isNull(),
        "pages": F.exists(f"{_RECORD}.pages", _page_is_odd),
        "validation_warnings": F.exists(f"{_RECORD}.validation_warnings", _warning_is_odd),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(odd, F.lit(False)), F.lit(name)) for name, odd in checks.items())), lambda x: x.isNotNull())
    return records.withColumn(_RECORD, r).withColumn("rejections", F.when(is_object, found).otherwise(F.array(F.lit("record")))).drop(_RECORD)


def skipped_pages(pages: DataFrame, key: str = "summary_id") -> DataFrame:
    """key, markdown, pages, skipped: the pages of each document in order, a mark for each unread one.

    ``pages`` has key, page (from 0), text and failed; a page without text is left out, an unread one
    never stops the others.
    """
    mark = F.concat(F.lit("[OCR_FAILED_PAGE_"), F.col("page") + 1, F.lit("]"))
    each = pages.select(key, "page", "failed", F.when(F.col("failed"), mark).otherwise(F.col("text")).alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text")))), lambda p: p["text"])
    return each.groupBy(key).agg(F.array_join(parts, "\n\n").alias("markdown"), F.count(F.lit(1)).alias("pages"), F.count_if("failed").alias("skipped"))
