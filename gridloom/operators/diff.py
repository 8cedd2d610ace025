"""Comparison of two versions: sections, headings and numeric cells.

Every diff is one full outer equi-join on the records' key.  Both sides are reduced by the same key
before (last entry wins), so that reduction and join share one exchange per side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.hashing import hex_padded, hex_plain, row_hash, two_decimals, unsigned

CELL_KEY = ["section_id", "table_id", "row_idx", "col_idx"]
VALUE_EPSILON = 1.0


def last_wins(entries: DataFrame, key: list[str], value: str, seq: str | None) -> DataFrame:
    """One row per key: the value of the highest ``seq``, ties by the greater value."""
    if seq is None:
        return entries.groupBy(*key).agg(F.max(value).alias(value))
    return entries.groupBy(*key).agg(F.max_by(value, F.struct(seq, value)).alias(value))


def differs(old: Column, new: Column, epsilon: float = VALUE_EPSILON) -> Column:
    """|old - new| >= epsilon, with NaN never differing."""
    gap = F.abs(old - new)
    return (gap >= epsilon) & ~F.isnan(gap)


def section_diff(old: DataFrame, new: DataFrame, key: str | list[str] = "section_id") -> DataFrame:
    """Ids on one side only: kind Removed or Added; repeated ids count once."""
    keys = [key] if isinstance(key, str) else key
    a = old.select(*keys).distinct().withColumn("in_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("in_new", F.lit(True))
    both = a.join(b, keys, "full_outer").where("in_old IS NULL OR in_new IS NULL")
    return both.select(*keys, F.when(F.col("in_old").isNull(), "Added").otherwise("Removed").alias("kind"))


def heading_diff(old: DataFrame, new: DataFrame, key: str | list[str] = "heading_id", seq: str | None = None) -> DataFrame:
    """Headings added, removed or of another level; order does not matter, repeated ids: last wins."""
    keys = [key] if isinstance(key, str) else key
    a = last_wins(old, keys, "level", seq).select(*keys, F.col("level").alias("old_level"), F.lit(True).alias("in_old"))
    b = last_wins(new, keys, "level", seq).select(*keys, F.col("level").alias("new_level"), F.lit(True).alias("in_new"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("in_old").isNull(), "Added").when(F.col("in_new").isNull(), "Removed").when(~F.col("old_level").eqNullSafe(F.col("new_level")), "Modified")
    found = both.withColumn("kind", kind).where("kind IS NOT NULL")
    description = F.when(F.col("kind") == "Modified", F.concat(F.lit("Heading level changed: H"), "old_level", F.lit(" → H"), "new_level"))
    return found.select(*keys, "kind", "old_level", "new_level", description.alias("description"))


def table_diff(old: DataFrame, new: DataFrame, key: list[str] | None = None, seq: str | None = None, epsilon: float = VALUE_EPSILON) -> DataFrame:
    """Cells added, removed or changed by ``epsilon`` or more, by place."""
    key = key or CELL_KEY
    a = last_wins(old, key, "numeric_value", seq).select(*key, F.col("numeric_value").alias("old_value"), F.lit(True).alias("in_old"))
    b = last_wins(new, key, "numeric_value", seq).select(*key, F.col("numeric_value").alias("new_value"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("in_old").isNull(), "Added").when(F.col("in_new").isNull(), "Removed").when(differs(F.col("old_value"), F.col("new_value"), epsilon), "Modified")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*key, "kind", "old_value", "new_value", F.when(F.col("kind") == "Modified", F.abs(F.col("old_value") - F.col("new_value"))).alias("delta"))


def snapshot_pairs(entries: DataFrame, delivered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old and new entries of every comparison of a project's snapshot with its previous delivered one.

    ``delivered`` (project_code, snapshot_no) has the deliveries; rows with a null are none.  On both
    sides ``snapshot_no`` is the later of the two and belongs into the key of the diff.
    """
    once = delivered.where("project_code IS NOT NULL AND snapshot_no IS NOT NULL").select("project_code", "snapshot_no").distinct()
    previous = F.lag("snapshot_no").over(Window.partitionBy("project_code").orderBy("snapshot_no"))
    pairs = once.withColumn("previous_no", previous).where("previous_no IS NOT NULL")
    old = entries.withColumnRenamed("snapshot_no", "previous_no").join(pairs, ["project_code", "previous_no"]).drop("previous_no")
    return old, entries.join(pairs.drop("previous_no"), ["project_code", "snapshot_no"])


def content_rows(rows: DataFrame, table_key: list[str], epsilon_free: str = "numeric_value") -> DataFrame:
    """Numeric cells of rows keyed by what the row says instead of where it stands.

    ``rows`` has the table key, row_pos and cells ARRAY<STRUCT<raw_text, numeric_value>>.  The anchor
    is the normalised text of the cells without numbers; equal rows are told apart by their order.
    """
    words = F.filter("cells", lambda c: c[epsilon_free].isNull())
    anchor = F.array_join(F.transform(words, lambda c: F.regexp_replace(F.lower(F.coalesce(c["raw_text"], F.lit(""))), r"(?U)\s+", " ")), "\u001f")
    keyed = rows.withColumn("anchor", F.xxhash64(anchor)).withColumn("copy", F.row_number().over(Window.partitionBy(*table_key, "anchor").orderBy("row_pos")))
    return keyed.select(*table_key, "anchor", "copy", F.posexplode("cells").alias("col_idx", "cell")).where("cell.numeric_value IS NOT NULL").select(*table_key, "anchor", "copy", "col_idx", F.col("cell.numeric_value").alias("numeric_value"))


def content_diff(old: DataFrame, new: DataFrame, table_key: list[str], epsilon: float = VALUE_EPSILON) -> DataFrame:
    """Table diff in which an inserted row does not shift the others."""
    key = [*table_key, "anchor", "copy", "col_idx"]
    return table_diff(content_rows(old, table_key), content_rows(new, table_key), key, None, epsilon)


_DELTA_COLUMNS = ["pass", "kind", *CELL_KEY, "heading_id", "old_value", "new_value", "delta", "old_level", "new_level"]


def diff_documents(sections: tuple[DataFrame, DataFrame], headings: tuple[DataFrame, DataFrame], cells: tuple[DataFrame, DataFrame], epsilon: float = VALUE_EPSILON, section_key: list[str] | None = None) -> DataFrame:
    """Deltas of all three passes in one table: 1 sections, 2 headings, 3 cells.

    Columns of ``section_key`` besides section_id come first and are null in the other passes.
    """
    section_key = section_key or ["section_id"]
    columns = [*(c for c in section_key if c != "section_id"), *_DELTA_COLUMNS]

    def shaped(df: DataFrame, number: int) -> DataFrame:
        types = {"heading_id": "bigint", "old_value": "double", "new_value": "double", "delta": "double", "old_level": "int", "new_level": "int", "section_id": "bigint", "table_id": "bigint", "row_idx": "int", "col_idx": "int", **{c: t for c, t in sections[0].dtypes if c in section_key}}
        full = df.withColumn("pass", F.lit(number))
        return full.select(*(F.col(c) if c in full.columns else F.lit(None).cast(types[c]).alias(c) for c in columns))

    return shaped(section_diff(*sections, section_key), 1).unionByName(shaped(heading_diff(*headings), 2)).unionByName(shaped(table_diff(*cells, epsilon=epsilon), 3))


def diff_summary(deltas: DataFrame) -> DataFrame:
    """One row: counts by kind and whether the versions are identical."""
    return deltas.agg(
        F.count(F.lit(1)).alias("total_deltas"),
        F.count_if(F.col("kind") == "Added").alias("added"),
        F.count_if(F.col("kind") == "Removed").alias("removed"),
        F.count_if((F.col("kind") == "Modified") & (F.col("pass") == 3)).alias("value_mismatches"),
        F.count_if((F.col("kind") == "Modified") & (F.col("pass") == 2)).alias("structural_changes"),
    ).withColumn("is_identical", F.col("total_deltas") == 0)


def report_rows(deltas: DataFrame, *keep: str) -> DataFrame:
    """Deltas as report rows: columns to keep, node_id, location, kind, old_value and new_value as texts."""
    hashed = deltas.withColumn("row_hash", row_hash("section_id", "table_id", F.col("row_idx").cast("long")))
    node = F.when(F.col("pass") == 3, F.col("row_hash").bitwiseXOR(F.col("col_idx").cast("long"))).when(F.col("pass") == 2, F.col("heading_id")).otherwise(F.col("section_id"))
    new_mark = F.when(F.col("kind") == "Added", " [NEW]").otherwise("")
    cell = F.concat(F.lit("Table "), unsigned(F.col("table_id")), F.lit(" > Row-Hash "), hex_plain(F.col("row_hash")), F.lit(", Col "), F.col("col_idx").cast("string"))
    location = F.when(F.col("pass") == 1, F.concat(F.lit("Section "), hex_plain(F.col("section_id")), new_mark)).when(F.col("pass") == 2, F.concat(F.lit("Heading "), hex_plain(F.col("heading_id")), new_mark)).otherwise(F.concat(F.lit("Section "), unsigned(F.col("section_id")), F.lit(" > "), cell, new_mark))
    changed = F.col("kind") == "Modified"
    level = F.concat(F.lit("Heading level changed: H"), "old_level", F.lit(" → H"), "new_level")
    return hashed.select(
        *keep,
        hex_padded(node).alias("node_id"),
        location.alias("location"),
        "kind",
        F.when(changed & (F.col("pass") == 3), two_decimals("old_value")).when(changed & (F.col("pass") == 2), level).alias("old_value"),
        F.when(changed & (F.col("pass") == 3), two_decimals("new_value")).alias("new_value"),
    )


def canonical_order(deltas: DataFrame) -> DataFrame:
    """A fixed order for exports: pass, Removed before Modified before Added, then the key."""
    rank = F.when(F.col("kind") == "Removed", 0).when(F.col("kind") == "Modified", 1).otherwise(2)
    return deltas.orderBy("pass", rank, "section_id", "heading_id", "table_id", "row_idx", "col_idx")
