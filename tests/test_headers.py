from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import headers as h

ROWS = "table_id string, row_pos int, cells array<struct<raw_text:string,numeric_value:double>>"


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("dwayne", "duane", 0.84), ("same", "same", 1.0), ("", "x", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert round(h._jaro_winkler(a, b), 4) == want


def test_jaro_winkler_against_sql():
    import duckdb

    words = ["khoi_luong", "khoi luong", "kl", "don_vi", "dvt", "hang_muc", "hang", "ghi_chu", "gi_chu", "ngay_lap"]
    for a in words:
        for b in words:
            assert abs(duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0] - h._jaro_winkler(a, b)) < 1e-9


def test_sniff_fill_and_filter(spark):
    rows = [("t", 0, [("1", 1.0), ("2", 2.0), ("x", None)]), ("t", 1, [("STT", None), ("Tên", None), ("", None)]), ("t", 2, [("STT", None), ("Tên", None), (None, None)]), ("t", 3, [("", None), ("Tổng cộng", None), ("5", 5.0)]), ("u", 0, [])]
    df = spark.createDataFrame(rows, ROWS)
    assert {r.table_id: (r.header_row, r.score) for r in h.sniff_header(df).collect()} == {"t": (1, 2), "u": (0, 0)}
    assert sorted((r.table_id, r.row_pos) for r in h.without_footers(df).collect()) == [("t", 0), ("t", 1), ("t", 2), ("u", 0)]
    names = spark.createDataFrame([("t", i, n) for i, n in enumerate(["", "A", None, " ", "B", ""])], "table_id string, col_pos int, name string")
    assert [r.filled for r in h.fill_merged(names).orderBy("col_pos").collect()] == ["", "A", "A_sub", "A_sub_2", "B", "B_sub"]
    canonical = spark.createDataFrame([("ten_cong_viec",), ("tt",), ("ma_hieu_don_gia",), ("kl_thuc_hien",), ("kl",), ("trang_thai",), (None,)], "h string").select(h.canonical_column(F.col("h")).alias("c"))
    assert [r.c for r in canonical.collect()] == ["dien_giai", None, "ma_hieu", "khoi_luong", "khoi_luong", "trang_thai", None]
    got = h.matched_headers(spark.createDataFrame([("Khối lương",), ("zzz",), (None,)], "name string"), ["khoi_luong", "don_vi"]).collect()
    assert [(r.name, r.match) for r in got] == [("Khối lương", "khoi_luong")]
