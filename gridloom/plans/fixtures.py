"""Operator inputs derived from the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.index import numeric_index_of_columns
from gridloom.sources.tables import load

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as table rows: one table per order, row_idx in a total order, the customer as section."""
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("section_id"))
    joined = load(spark, folder, "lineitem").join(orders, "l_orderkey")
    row = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1
    return joined.withColumns({"row_idx": row, "table_id": F.col("l_orderkey")})


def version_a(rows: DataFrame) -> DataFrame:
    return numeric_index_of_columns(rows, ["section_id", "table_id", "row_idx"], MEASURES)


def changed_lines(rows: DataFrame) -> DataFrame:
    """The second version: some prices and quantities changed, some first rows dropped."""
    price = F.col("l_extendedprice") + F.when(F.col("l_partkey") % 7 == 0, 2.0).when(F.col("l_partkey") % 5 == 0, 0.5).otherwise(0.0)
    quantity = F.col("l_quantity") + F.when(F.col("l_suppkey") % 3 == 0, 1.0).otherwise(0.0)
    return rows.where(~((F.col("l_orderkey") % 11 == 0) & (F.col("row_idx") == 0))).withColumns({"l_extendedprice": price, "l_quantity": quantity})


def version_b(rows: DataFrame) -> DataFrame:
    added = rows.where(F.col("l_orderkey") % 13 == 0).select("section_id", "table_id").distinct().select("section_id", "table_id", F.lit(1000).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit(1.0).alias("numeric_value"))
    return version_a(changed_lines(rows)).unionByName(added)


def text_elements(rows: DataFrame) -> DataFrame:
    """Every measure of every line as a positioned text on its order's page."""
    cells = rows.select(F.col("l_orderkey").alias("page_id"), "row_idx", "l_linenumber", "l_partkey", F.posexplode(F.array(*(F.col(c).cast("string") for c in MEASURES))).alias("col", "text"))
    x0, y0 = F.col("col") * 100.0, F.col("row_idx") * 20.0 + F.col("l_partkey") % 5
    return cells.select("page_id", (F.col("row_idx") * 4 + F.col("col")).alias("seq"), "text", x0.alias("x0"), y0.alias("y0"), (x0 + 40 + F.col("l_linenumber")).alias("x1"), (y0 + 10).alias("y1"))


SQL_LINES = f"""
lines AS (
  SELECT o.o_custkey AS section_id, l.l_orderkey AS table_id,
         (row_number() OVER (PARTITION BY l.l_orderkey ORDER BY {", ".join("l." + c for c in _ORDER)}) - 1)::INT AS row_idx, l.*
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
), changed AS (
  SELECT * REPLACE (
    l_extendedprice + CASE WHEN l_partkey % 7 = 0 THEN 2.0 WHEN l_partkey % 5 = 0 THEN 0.5 ELSE 0.0 END AS l_extendedprice,
    l_quantity + CASE WHEN l_suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS l_quantity)
  FROM lines WHERE NOT (l_orderkey % 11 = 0 AND row_idx = 0)
)"""


def _sql_unpivot(source: str) -> str:
    return " UNION ALL ".join(f"SELECT section_id, table_id, row_idx, {k} AS col_idx, {c}::DOUBLE AS numeric_value FROM {source}" for k, c in enumerate(MEASURES))


SQL_VERSIONS = f"""{SQL_LINES}, a AS ({_sql_unpivot("lines")}), b AS (
  {_sql_unpivot("changed")}
  UNION ALL SELECT DISTINCT section_id, table_id, 1000, 0, 1.0 FROM lines WHERE l_orderkey % 13 = 0
)"""
