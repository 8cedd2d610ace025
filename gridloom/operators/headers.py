"""Headers of tables: which row they are in, what their columns mean, and rows that are no data."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import fold

SNIFFED_ROWS = 20
MOST_NUMBERS = 0.7
LEAST_SIMILARITY = 0.85
#: Canonical columns and what their normalised headers contain; fixed values.
ALIASES = {
    "ma_hieu": ["ma_hieu", "ma_so", "code"],
    "dien_giai": ["dien_giai", "noi_dung", "hang_muc", "ten_cong_viec", "description"],
    "dvt": ["dvt", "don_vi", "unit"],
    "khoi_luong": ["khoi_luong", "so_luong", "kl_", "kl", "quantity", "qty"],
    "don_gia": ["don_gia", "unit_price", "price"],
    "thanh_tien": ["thanh_tien", "gia_tri", "amount", "total_cost"],
    "trang_thai": ["trang_thai", "tinh_trang", "status"],
    "ngay_tao": ["ngay", "date"],
}
#: Rows with one of these phrases in a cell are no data; fixed values.
FOOTERS = ("Tổng cộng", "Cộng", "Ký tên", "Ghi chú", "Xác nhận")


def canonical_column(header: Column) -> Column:
    """The canonical column whose alias the normalised header contains; the first in order holds."""
    out = F.lit(None).cast("string")
    for name, parts in reversed(ALIASES.items()):
        hit = functools.reduce(lambda a, b: a | b, [F.contains(header, F.lit(p)) if len(p) > 2 else header == p for p in parts])
        out = F.when(hit, name).otherwise(out)
    return out


def sniff_header(rows: DataFrame, key: str = "table_id") -> DataFrame:
    """The likeliest header row of each table among its first rows: most filled cells that are words.

    A row of which more than ``MOST_NUMBERS`` of the cells are numbers scores nothing; ties go to
    the first row.
    """
    early = rows.where(F.col("row_pos") < SNIFFED_ROWS)
    filled = F.size(F.filter("cells", lambda c: F.coalesce(c["raw_text"].rlike(r"(?U)\S"), F.lit(False))))
    numbers = F.size(F.filter("cells", lambda c: c["numeric_value"].isNotNull()))
    score = F.when(numbers > MOST_NUMBERS * F.size("cells"), 0).otherwise(filled - numbers)
    return early.groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("row_pos")).alias("before"))).alias("b")).select(key, (-F.col("b.before")).alias("header_row"), F.col("b.score").alias("score"))


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, [c for c, u in zip(b, used) if u])) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts in [0, 1]; null where one is null."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def matched_headers(names: DataFrame, wanted: list[str], least: float = LEAST_SIMILARITY) -> DataFrame:
    """name, match, similarity: the likeliest of a short list of headers for each distinct name, accents aside."""
    candidates = names.where("name IS NOT NULL").select("name", F.replace(fold(F.col("name")), F.lit(" "), F.lit("_")).alias("header")).distinct().withColumn("match", F.explode(F.array(*map(F.lit, wanted))))
    scored = candidates.withColumn("similarity", jaro_winkler("header", "match")).where(F.col("similarity") >= least)
    return scored.groupBy("name").agg(F.max(F.struct("similarity", "match")).alias("m")).select("name", "m.match", "m.similarity")


def fill_merged(headers: DataFrame, key: str = "table_id") -> DataFrame:
    """Names for the empty cells right of a merged header: X, X_sub, X_sub_2 and so on.

    ``headers`` has key, col_pos and name; a cell left of any name stays empty.
    """
    order = Window.partitionBy(key).orderBy("col_pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("name").rlike(r"(?U)\S"), F.col("name"))
    named = headers.withColumn("base", F.last(own, ignorenulls=True).over(order)).withColumn("part", F.count(own).over(order))
    n = F.row_number().over(Window.partitionBy(key, "part").orderBy("col_pos")) - 1
    filled = F.when(F.col("base").isNull(), "").when(n == 0, F.col("base")).when(n == 1, F.concat("base", F.lit("_sub"))).otherwise(F.concat("base", F.lit("_sub_"), n))
    return named.select(key, "col_pos", filled.alias("filled"))


def without_footers(rows: DataFrame) -> DataFrame:
    """Rows none of whose cells contains a footer phrase, in capitals or not."""
    footer = "|".join(p.lower() for p in FOOTERS)
    return rows.where(~F.exists("cells", lambda c: F.coalesce(F.lower(c["raw_text"]).rlike(footer), F.lit(False))))
