"""Rows and columns of tables from positioned text, and broken rows put together again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP_TOLERANCE = 5.0
LEAST_GAP = 5.0
SNAPPED = "page_id bigint, row_no int, place int, seq int, text string, x0 double, y0 double, x1 double, y1 double"


def _snapper(tolerance: float):
    """Leader clustering over batches sorted by page and y centre.

    What is carried from batch to batch is the leader and the elements of the open row, so that a
    page may be as large as it likes.
    """

    def snap(batches):
        page, leader, number = None, 0.0, -1
        open_row: pd.DataFrame | None = None
        for batch in batches:
            rows = np.empty(len(batch), np.int32)
            for i, (p, cy) in enumerate(zip(batch.page_id.tolist(), batch.cy.tolist(), strict=True)):
                if p != page:
                    page, leader, number = p, cy, 0
                elif not abs(cy - leader) <= tolerance:
                    leader, number = cy, number + 1
                rows[i] = number
            batch = batch.assign(row_no=rows)
            if open_row is not None:
                batch = pd.concat([open_row, batch], ignore_index=True)
            last = (batch.page_id == batch.page_id.iloc[-1]) & (batch.row_no == batch.row_no.iloc[-1]) if len(batch) else []
            open_row = batch[last] if len(batch) else open_row
            yield _placed(batch[~last]) if len(batch) else _placed(batch.assign(row_no=[]))
        if open_row is not None:
            yield _placed(open_row)

    return snap


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    page, number = rows.page_id.to_numpy(), rows.row_no.to_numpy(np.int32)
    rows = rows.take(np.lexsort((rows.seq, rows.cy, rows.x0, number, page)))
    page, number = rows.page_id.to_numpy(), rows.row_no.to_numpy(np.int32)
    # the place within the row: how far each element is from where its row begins
    begins = np.r_[True, (page[1:] != page[:-1]) | (number[1:] != number[:-1])][: len(rows)]
    at = np.arange(len(rows))
    place = at - np.maximum.accumulate(np.where(begins, at, 0)) if len(rows) else at
    return rows.assign(row_no=number, place=place.astype(np.int32))[["page_id", "row_no", "place", "seq", "text", "x0", "y0", "x1", "y1"]]


def snap_rows(elements: DataFrame, tolerance: float = SNAP_TOLERANCE) -> DataFrame:
    """Rows of each page by greedy leader clustering of the y centres.

    An element joins the open row while its centre is within ``tolerance`` of the row's first
    element; each row is ordered by x0.  The leader depends on all elements before it, which window
    functions cannot say: pages are sorted within partitions and streamed once.  Elements without
    page or place are left out.
    """
    centred = elements.where("page_id IS NOT NULL").withColumn("cy", (F.col("y0") + F.col("y1")) / 2).where("cy IS NOT NULL")
    columns = ["page_id", "seq", "text", "x0", "y0", "x1", "y1", "cy"]
    return centred.select(*columns).repartition("page_id").sortWithinPartitions("page_id", "cy", "seq").mapInPandas(_snapper(tolerance), SNAPPED)


def _ink(elements: DataFrame, width: Column | None) -> DataFrame:
    """Whole-number ink spans [start, stop]; negative and NaN places count as 0."""

    def cell(x: Column) -> Column:
        return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.floor(x).cast("double"), F.lit(0.0))).cast("long")

    right = F.col("x1") if width is None else F.least(F.col("x1"), width)
    return elements.select("page_id", cell(F.col("x0")).alias("start"), cell(right).alias("stop")).where("start <= stop")


def density_histogram(elements: DataFrame, page_width: Column | None = None) -> DataFrame:
    """How many elements ink each x place of each page."""
    return _ink(elements, page_width).select("page_id", F.explode(F.sequence("start", "stop")).alias("x")).groupBy("page_id", "x").agg(F.count(F.lit(1)).alias("ink"))


def column_boundaries(elements: DataFrame, page_width: Column | None = None, least_gap: float = LEAST_GAP) -> DataFrame:
    """Middles of the gaps wider than ``least_gap`` between the ink of a page's elements.

    Interval merge by one window instead of the histogram; margins left and right do not count.
    """
    before = Window.partitionBy("page_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    gaps = _ink(elements, page_width).withColumn("gap_start", F.max("stop").over(before) + 1)
    return gaps.where(F.col("start") - F.col("gap_start") > least_gap).select("page_id", ((F.col("gap_start") + F.col("start")) / 2).alias("boundary")).distinct()


def merge_broken_rows(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """Rows without numbers joined to the Data row above them, cell by cell.

    A row without numbers goes into the open parent if that is a Data row, whatever its own type.
    Cell texts are joined by single spaces, blanks skipped; the parent keeps its numbers and its
    number of cells.  ``rows`` has key, row_pos, row_type and cells; gives key, row_no, row_pos,
    row_type and cells of the joined rows.
    """
    order = Window.partitionBy(key).orderBy("row_pos")
    numbered = rows.withColumn("has_number", F.exists("cells", lambda c: c["numeric_value"].isNotNull()))
    numbered = numbered.withColumn("first", F.row_number().over(order) == 1)
    numbered = numbered.withColumn("part", F.sum((F.col("has_number") | F.col("first")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "part").orderBy("row_pos")
    data_before = F.sum((F.col("row_type") == "Data").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    starts = (F.row_number().over(inside) == 1) | (F.coalesce(data_before, F.lit(0)) == 0)
    placed = numbered.withColumn("row_no", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    grouped = placed.groupBy(key, "row_no").agg(F.array_sort(F.collect_list(F.struct("row_pos", "row_type", "cells"))).alias("members"))
    parent = F.element_at("members", 1)

    def joined(cell: Column, i: Column) -> Column:
        texts = F.transform("members", lambda m: F.regexp_replace(F.coalesce(F.get(m["cells"], i)["raw_text"], F.lit("")), r"(?U)^\s+|\s+$", ""))
        more = F.filter(F.slice(texts, 2, F.greatest(F.size("members") - 1, F.lit(1))), lambda t: t != "")
        text = F.when(F.size(more) > 0, F.array_join(F.filter(F.concat(F.slice(texts, 1, 1), more), lambda t: t != ""), " ")).otherwise(cell["raw_text"])
        return F.struct(text.alias("raw_text"), cell["numeric_value"].alias("numeric_value"))

    return grouped.select(key, "row_no", parent["row_pos"].alias("row_pos"), parent["row_type"].alias("row_type"), F.transform(parent["cells"], joined).alias("cells"))
