"""Flat indexes over nested documents and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numeric_index_of_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of table rows by position; empty rows keep their place, null numbers are left out.

    ``rows`` has the keys, row_pos and cells ARRAY<STRUCT<raw_text, numeric_value>>.
    """
    cells = rows.select(*keys, F.col("row_pos").alias("row_idx"), F.posexplode("cells").alias("col_idx", "cell"))
    return cells.where("cell.numeric_value IS NOT NULL").select(*keys, "row_idx", "col_idx", F.col("cell.numeric_value").alias("numeric_value"))


def numeric_index_of_columns(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Numbers of a wide table, one row per column: an unpivot without an exchange."""
    values = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("col_idx", "numeric_value")
    return wide.select(*keys, values).where("numeric_value IS NOT NULL")


def heading_entries(sections: DataFrame) -> DataFrame:
    """section_id, node_pos, node_id, level, text of all headings in ``nodes``."""
    return sections.select("section_id", F.posexplode("nodes").alias("node_pos", "node")).where("node.kind = 'Heading'").select("section_id", "node_pos", "node.node_id", "node.level", "node.text")


def section_ids(sections: DataFrame) -> DataFrame:
    return sections.select("section_id")
