"""Validated tables rolled up into totals, with the cells that made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("total_cost", "total_paid", "budget", "actual")
#: Bounds of the deviation bands, in percent.
WARNING_FROM, CRITICAL_FROM = 5.0, 15.0


def named_cells(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells with the name of the column at their position ('' where none is defined)."""
    names = tables.select("table_id", F.posexplode("columns").alias("col_pos", "c")).select("table_id", "col_pos", F.col("c.name").alias("column_name"))
    return cells.join(names, ["table_id", "col_pos"], "left").withColumn("column_name", F.coalesce("column_name", F.lit("")))


def contributions(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Lineage in long form: the Float cells that a metric column holds, whatever their stored labels."""
    able = cells.where((F.col("tag") == "Float") & F.col("f").isNotNull())
    found = named_cells(able, tables.select("table_id", "columns")).where(F.col("column_name").isin(*METRICS))
    return found.select(*keys, F.col("column_name").alias("metric"), "table_id", "row_pos", "col_pos", F.col("f").alias("contribution"))


def deviation_status(percentage: Column) -> Column:
    """Band of a deviation; NaN is in the last one."""
    return F.when(F.isnan(percentage), "CRITICAL").when(percentage < WARNING_FROM, "SAFE").when(percentage < CRITICAL_FROM, "WARNING").otherwise("CRITICAL")


def rollup(lineage: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the metrics by key with the figures derived from them; a missing metric is 0.0."""
    sums = lineage.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("contribution"))), F.lit(0.0)).alias(m) for m in METRICS))
    absolute = F.col("actual") - F.col("budget")
    percentage = F.when(F.col("budget") != 0, absolute / F.col("budget") * 100).otherwise(0.0)
    return sums.withColumns({"remaining": F.col("total_cost") - F.col("total_paid"), "deviation": absolute, "percentage": percentage, "status": deviation_status(percentage)})


def lineage_map(lineage: DataFrame, keys: list[str]) -> DataFrame:
    """Lineage as one map per key; a metric without contribution has no entry.

    For reports on single projects: a list holds all contributions of a metric; use the long form
    where that is not bounded.
    """
    entry = F.struct("table_id", "row_pos", "col_pos", "contribution")
    lists = lineage.groupBy(*keys, "metric").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", "entries"))).alias("lineage"))


def table_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables and rows really there (not the declared counts)."""
    rows = cells.select(*keys, "table_id", "row_pos").distinct()
    return rows.groupBy(*keys).agg(F.count_distinct("table_id").alias("table_count"), F.count(F.lit(1)).alias("row_count"))
