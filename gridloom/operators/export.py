"""Markdown and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pipe_rows(rows: Column, keep_empty: bool) -> Column:
    """Pipe rows of a table; a separator follows every Header row, an empty row is one pipe or left out."""

    def line(row: Column) -> Column:
        cells = F.concat(F.lit("|"), F.array_join(F.transform(row["cells"], lambda c: F.concat(F.lit(" "), F.coalesce(c["raw_text"], F.lit("")), F.lit(" |"))), ""), F.lit("\n"))
        rule = F.when(row["row_type"] == "Header", F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(row["cells"])), F.lit("\n"))).otherwise("")
        whole = F.concat(cells, rule)
        return whole if keep_empty else F.when(F.size(row["cells"]) > 0, whole).otherwise("")

    return F.array_join(F.transform(rows, line), "")


def table_markdown(rows: DataFrame, key: str = "table_id", keep_empty: bool = False) -> DataFrame:
    """Markdown of each table: pipes are not escaped, empty tables are left out.

    Empty rows are left out as well, unless they are kept, as a streaming writer does.
    """
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row_pos", "row_type", "cells"))).alias("rows"))
    return ordered.select(key, _pipe_rows(F.col("rows"), keep_empty).alias("markdown")).where("markdown <> ''")


def node_markdown(kind: Column, level: Column, text: Column) -> Column:
    """Markdown of one node: paragraphs trimmed and left out when blank, fragments never written."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    heading = F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), F.coalesce(text, F.lit("")), F.lit("\n\n"))
    return (
        F.when(kind == "Heading", heading)
        .when((kind == "Paragraph") & (plain != ""), F.concat(plain, F.lit("\n\n")))
        .when((kind == "Table") & (plain != ""), F.concat(text, F.lit("\n\n")))
        .otherwise("")
    )


def section_markdown(title: Column, level: Column, nodes: Column) -> Column:
    """Markdown of a section: its title as heading, then its nodes, in one row expression."""
    body = F.array_join(F.transform(nodes, lambda n: node_markdown(n["kind"], n["level"], n["text"])), "")
    return F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def document_markdown(sections: DataFrame, key: str = "summary_id") -> DataFrame:
    """Markdown of each document from its sections in order; repeated sections count once."""
    once = sections.groupBy(key, "section_id").agg(F.max_by(F.struct("section_pos", "title", "level", "nodes"), "loaded_at").alias("s"))
    each = once.select(key, "section_id", "s.section_pos", section_markdown(F.col("s.title"), F.col("s.level"), F.col("s.nodes")).alias("md"))
    parts = F.array_sort(F.collect_list(F.struct("section_pos", "section_id", "md")))
    return each.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["md"]), "").alias("markdown"))


def built_lines(nodes: DataFrame, key: str = "summary_id") -> DataFrame:
    """What a streaming writer emits node by node, with its counters.

    ``nodes`` has key, pos, kind, level, text and is_end (the buffer is closed under this node's
    title).  Paragraphs are written untrimmed, blank ones too; section_no counts closed sections
    from 1 and table_no counts every table of the document, empty ones too; what stays in the buffer
    goes to a last section without number (0).
    """
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    ended = F.coalesce(F.sum(F.col("is_end").cast("int")).over(order) - F.col("is_end").cast("int"), F.lit(0))
    still = F.sum(F.col("is_end").cast("int")).over(back)
    text = F.coalesce("text", F.lit(""))
    md = F.when(F.col("kind") == "Heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), text, F.lit("\n\n"))).when(F.col("kind") == "Paragraph", F.concat(text, F.lit("\n\n"))).when(F.col("kind") == "Table", F.concat(text, F.lit("\n"))).otherwise("")
    return nodes.select(key, "pos", "kind", F.when(still > 0, ended + 1).otherwise(0).alias("section_no"), F.sum((F.col("kind") == "Table").cast("int")).over(order).alias("table_no"), md.alias("markdown"))


def summary_json(document_summary: DataFrame) -> DataFrame:
    """Document summaries as JSON in camel case."""
    fields = F.struct("id", F.col("source_path").alias("sourcePath"), F.col("total_pages").alias("totalPages"), F.col("has_ocr").alias("hasOcr"), F.coalesce("markdown", F.lit("")).alias("markdown"))
    return document_summary.select("id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def delta_json(report_rows: DataFrame, *keep: str) -> DataFrame:
    """Report rows as JSON in camel case, one object a delta; missing values are null in it."""
    fields = F.struct(F.col("node_id").alias("nodeId"), "kind", "location", F.col("old_value").alias("oldValue"), F.col("new_value").alias("newValue"))
    return report_rows.select(*keep, F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def report_json(summary: DataFrame) -> DataFrame:
    """The head of a report (its deltas are lines of their own, however many)."""
    return summary.select(F.to_json(F.struct(F.col("is_identical").alias("isIdentical"), F.col("total_deltas").alias("totalDeltas"))).alias("json"))


def write_markdown(documents: DataFrame, path: str) -> None:
    """Each document's Markdown as text files, by all executors."""
    documents.select("markdown").write.mode("overwrite").text(path, lineSep="\n")
