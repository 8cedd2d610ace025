"""Queries over the operators on training text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import encoding, language, leak, mix, ocr, split, unify
from gridloom.sources.tables import load


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return split.section_items(load(spark, folder, "sections")).unionByName(split.markdown_items(load(spark, folder, "document_summary")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    plans = split.split_plans(_items(spark, folder), load(spark, folder, "size_limits"))
    return plans.where(F.size("cuts") > 1).select("item_kind", "item_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(_items(spark, folder), load(spark, folder, "size_limits"))


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    whole = split.rejoined(p1_pieces(spark, folder))
    return whole.select("item_kind", "item_id", F.md5("text").alias("md5"), F.length("text").cast("long").alias("n_chars"), "longest").join(load(spark, folder, "size_limits"), "item_kind").select("item_kind", "item_id", "md5", "n_chars", (F.col("longest") <= F.col("max_chars")).alias("within"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_texts(load(spark, folder, "cells").select("global_id", "source_text")).select("global_id").distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    found = encoding.garbled_texts(load(spark, folder, "cells").select("global_id", "source_text"))
    return found.select("global_id", "source_text", "encoding_repair.*").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    texts = unify.field_texts(load(spark, folder, "physical_rows"), load(spark, folder, "extracted_tables"))
    return unify.altered_texts(texts).select("field", "table_id", "row_pos", "cell_pos").distinct()


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    texts = unify.field_texts(load(spark, folder, "physical_rows"), load(spark, folder, "extracted_tables"))
    return unify.unified(texts).select("field", "table_id", "row_pos", "cell_pos", "text", "unified.clean", "unified.canonical").distinct()


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.scanned_texts(load(spark, folder, "document_summary"), load(spark, folder, "physical_rows"), load(spark, folder, "cells"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return ocr.noisy_texts(_scanned(spark, folder)).select("field", "record_key").distinct()


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    noisy = ocr.repaired(_scanned(spark, folder)).where("scan.mended > 0 OR scan.corrected > 0 OR scan.furniture > 0")
    return noisy.select("field", "record_key", "scan.*").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaked_items(load(spark, folder, "documents").select("doc_id", "text"), load(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    clean = leak.without_leaks(load(spark, folder, "documents").select("doc_id", "text"), load(spark, folder, "eval_items"))
    return clean.where("removed_words > 0").select("doc_id", "removed_words", "text").distinct()


def p7_removed(spark: SparkSession, folder: str) -> DataFrame:
    return p7_clean(spark, folder).select("doc_id", F.col("removed_words").cast("long").alias("removed_words"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(load(spark, folder, "documents").select("doc_id", "source", "text"), load(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix.reached_shares(*mix.mix(load(spark, folder, "documents").select("doc_id", "source", "text"), load(spark, folder, "mix_targets")))


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    targets = load(spark, folder, "mix_targets")
    return mix.kept_limits(*mix.mix(load(spark, folder, "documents").select("doc_id", "source", "text"), targets), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.unlabelled_languages(load(spark, folder, "documents").select("doc_id", "text", "lang"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return language.document_languages(load(spark, folder, "documents").select("doc_id", "text", "lang"))


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = language.language_segments(load(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.start_char", "s.end_char", "s.lang", "s.confidence", "s.sentences")


P1_FOUND_SQL = r"""
WITH sec AS (
  SELECT 'section' AS item_kind, section_id::VARCHAR AS item_id,
         array_to_string([n.text FOR n IN nodes IF n.text IS NOT NULL AND regexp_matches(n.text, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')], chr(10) || chr(10)) AS text
  FROM sections WHERE section_id IS NOT NULL
), items AS (SELECT * FROM sec UNION ALL SELECT 'markdown', id, markdown FROM document_summary WHERE id IS NOT NULL)
"""
P1_REJOINED_SQL = P1_FOUND_SQL + "SELECT DISTINCT i.item_kind, i.item_id, md5(i.text) AS md5, length(i.text) AS n_chars, true AS within FROM items i JOIN size_limits l USING (item_kind) WHERE length(i.text) > l.max_chars"
P1_FOUND_SQL += "SELECT DISTINCT i.item_kind, i.item_id FROM items i JOIN size_limits l USING (item_kind) WHERE length(i.text) > l.max_chars"

P4_FOUND_SQL = f"""
WITH t AS (
  SELECT 'raw_text' AS field, table_id, row_pos, generate_subscripts(cells, 1)::INT - 1 AS cell_pos, unnest(cells).raw_text AS text FROM physical_rows
  UNION ALL
  SELECT 'name', table_id, -1, generate_subscripts(columns, 1)::INT - 1, unnest(columns).name FROM extracted_tables
)
SELECT DISTINCT field, table_id, row_pos, cell_pos FROM t
WHERE text IS NOT NULL AND (nfc_normalize(text) <> text OR regexp_matches(text, '{unify.case_class()}'))
"""

_INVISIBLE = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in unify.ignorable_characters() if ord(c) < 0x10000) + "]"
P7_FOUND_SQL = f"""
WITH t AS (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM eval_items),
w AS (SELECT kind, id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '{_INVISIBLE}', '', 'g'))), '[\\p{{L}}\\p{{N}}]+') AS words FROM t WHERE text IS NOT NULL),
g AS (SELECT DISTINCT kind, id, array_to_string(list_slice(words, k, k + {leak.MIN_WORDS - 1}), ' ') AS gram
      FROM (SELECT kind, id, words, unnest(range(1, len(words) - {leak.MIN_WORDS - 2})) AS k FROM w WHERE len(words) >= {leak.MIN_WORDS}))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i USING (gram) WHERE d.kind = 'doc' AND i.kind = 'item'
"""

# the words that lie in any passage of MIN_WORDS words of an item
P7_REMOVED_SQL = f"""
WITH t AS (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM eval_items),
w AS (SELECT kind, id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '{_INVISIBLE}', '', 'g'))), '[\\p{{L}}\\p{{N}}]+') AS words FROM t WHERE text IS NOT NULL),
g AS (SELECT kind, id, k, array_to_string(list_slice(words, k, k + {leak.MIN_WORDS - 1}), ' ') AS gram
      FROM (SELECT kind, id, words, unnest(range(1, len(words) - {leak.MIN_WORDS - 2})) AS k FROM w WHERE len(words) >= {leak.MIN_WORDS})),
h AS (SELECT DISTINCT id, unnest(range(k, k + {leak.MIN_WORDS})) AS place FROM g WHERE kind = 'doc' AND gram IN (SELECT gram FROM g WHERE kind = 'item'))
SELECT id AS doc_id, count(*) AS removed_words FROM h GROUP BY 1
"""
P8_LIMITS_SQL = "SELECT DISTINCT plan_name, source, true AS within_repeats, true AS near_target FROM mix_targets WHERE plan_name IS NOT NULL AND source IS NOT NULL"

QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rejoined": p1_rejoined, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_unified": p4_unified, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_found": p7_found, "p7_clean": p7_clean, "p7_removed": p7_removed, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_limits": p8_limits, "p9_found": p9_found, "p9_documents": p9_documents, "p9_passages": p9_passages}
SQL = {"p1_found": P1_FOUND_SQL, "p1_rejoined": P1_REJOINED_SQL, "p4_found": P4_FOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_removed": P7_REMOVED_SQL, "p8_limits": P8_LIMITS_SQL}
