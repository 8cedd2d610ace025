from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import normalize as nz
from gridloom.functions import text as tx
from gridloom.functions.hashing import hex_padded, hex_plain, row_hash, stable_id, two_decimals, unsigned
from gridloom.functions.numbers import sanitize_number
from gridloom.functions.unit_names import unit_in_name, unit_of, written_number_and_unit

NUMBERS = {
    "1.250.000,50": 1250000.5, "1.000,5": 1000.5, "500,00": 500.0, "1,250,000.50": 1250000.5, "1,000.5": 1000.5, "500.00": 500.0, "1 500 000": 1500000.0, "[500]": 500.0,
    "1 250 000.50": 1250000.5, "1 250 000,50": 1250000.5, "l.2S0.000,5o": 1250000.5, "o.50": 0.5, "I.000": 1000.0, "(1.250.000,50)": -1250000.5, "-1,500.00": -1500.0,
    "Không có số": None, "": None, "   ": None, "3.14159": 314159.0, "1.000": 1000.0, "5,": 5.0, ".5": 0.5, ".": None, ",": None, "(1.0)": -1.0, "(-5)": -5.0, "-(5)": -5.0,
    "1,000.5.6": None, "5-": 5.0, "1,2,3.4": 123.4, "(1,5 )": -1.5, "(1,50 )": -150.0, "1e5": 15.0, "12%": 12.0, "Total": 1.0, "Hello": 110.0, "Is": 1.0, "Sum": 5.0,
    "- Đào móng": 0.0, "Tổng": None, "1 000": None, "1\t000": None, "１２": None, "1\n": 1.0,
}


def test_sanitize_number(spark):
    rows = spark.createDataFrame([(k,) for k in NUMBERS], "raw string")
    got = {r.raw: r.v for r in rows.select("raw", (sanitize_number(F.col("raw")) + 0.0).alias("v")).collect()}
    assert got == NUMBERS
    assert spark.sql("SELECT CAST(NULL AS STRING) AS raw").select(sanitize_number(F.col("raw")).alias("v")).first().v is None


def test_normalizers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(nz.normalize_header(F.lit("  Tên   công việc  "))) == "ten_cong_viec"
    assert value(nz.normalize_header(F.lit("ten_cong_viec"))) == "ten_cong_viec"
    assert value(nz.normalize_header(F.lit(" ĐƠN VỊ "))) == "don_vi"
    assert [value(nz.normalize_unit(F.lit(u))) for u in (" M2 ", "mét vuông", "tan", "unknown", "m²")] == ["m²", "m²", "tấn", None, None]
    assert [value(nz.normalize_number(F.lit(x))) for x in (1.2345, 1.2344, 0.0001, 0.0005, 0.5005)] == [1.235, 1.234, 0.0, 0.001, 0.5]
    tags = [value(nz.normalize_null(F.lit(x))) for x in ("", " - ", "0", "0.0", " a ")]
    assert [(t.tag, t.f, t.s) for t in tags] == [("Null", None, None), ("Null", None, None), ("Float", 0.0, None), ("Text", None, "0.0"), ("Text", None, "a")]
    assert value(nz.extension(F.lit("/a/b.x/File.PDF"))) == "pdf" and value(nz.extension(F.lit("/a/.docx"))) == "" and value(nz.extension(F.lit("/a.b/c"))) == ""
    assert value(nz.progress_percent(F.lit(1), F.lit(0))) == 0.0
    assert value(nz.unknown_share(F.lit("a�"))) == 0.5


def test_identities(spark):
    df = spark.createDataFrame([(1, 1, 0), (-5, 7, 3)], "a bigint, b bigint, c bigint")
    hashes = [r.h for r in df.select(hex_padded(row_hash("a", "b", "c")).alias("h")).collect()]

    def mix(a, b, c):
        k, m = 0x517CC1B727220A95, (1 << 64) - 1
        h = (a * k + b) & m
        h = ((h << 5) | (h >> 59)) & m
        return (h * k + c) & m

    assert hashes == [f"{mix(a & (2**64 - 1), b, c):016x}" for a, b, c in [(1, 1, 0), (-5, 7, 3)]]
    assert hashes[0] == "3cdda0d32c151392"
    row = spark.range(1).select(stable_id(F.lit("ab"), F.lit("c")).alias("x"), stable_id(F.lit("a"), F.lit("bc")).alias("y"), unsigned(F.lit(-1)).alias("u"), hex_plain(F.lit(255)).alias("p")).first()
    assert row.x != row.y and row.u == str(2**64 - 1) and row.p == "ff"
    texts = spark.createDataFrame([(1.005,), (0.125,), (None,), (-2.5,)], "v double").select(two_decimals("v").alias("t"))
    assert [r.t for r in texts.collect()] == ["1.00", "0.12", None, "-2.50"]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_fold_is_stable(text):
    once = tx.fold_text(text)
    assert tx.fold_text(once) == once


def test_fold_alike_in_both_engines(spark):
    texts = ["Khối lượng [m²]", "Ηạnɡ mục", "1.000 VNÐ", "ｍ＾２", "Hạng mục", "a​b  c", "ĐƠN VỊ", "đồng"]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.fold(F.col("t")).alias("f")).collect()]
    assert got == [tx.fold_text(t) for t in texts]
    assert got[0] == "khoi luong [m2]" and got[1] == "hang muc" and got[4] == "hang muc"


@pytest.mark.parametrize("word", ["nghiêng", "thuở", "khuỷu", "quyết", "ngoằn", "giữa", "đường", "ý", "hoá", "hòa", "uống"])
def test_syllables(word):
    assert tx.is_vietnamese_syllable(word) and tx.is_vietnamese_syllable(word.upper()) and tx.is_vietnamese_syllable(unicodedata.normalize("NFD", word))


@pytest.mark.parametrize("word", ["phèi", "cliấp", "theùp", "légère", "fông", "tbép", "nhấc̣"])
def test_no_syllables(word):
    assert not tx.is_vietnamese_syllable(word)


def test_units_named_by_texts(spark):
    cases = {
        "-4.158,40 Kg": "kg", "758.31khối": "m3", "(1.484,24) m²": "m2", "2.31tỷ đồng": "b_vnd", "l7,5 tạ": "ta", "5,62lit": "l", "12,50 100m2": "100m2", "5,62 T": "t", "100 1000đ": "k_vnd",
        "8,5 tr.đ": "m_vnd", "3 10^6 đồng": "m_vnd", "4.700,1 mÂ²": None, "7 cái": None, "12,5": None, "S4,38": None, "": None, "m2": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("u", written_number_and_unit(F.col("t"))[1])
    got = {r.t: r.u for r in df.collect()}
    assert {k: v for k, v in got.items() if v != cases[k]} == {}
    units = {"mÂ²": "m2", "táº¡": "ta", "M^2": "m2", "VNĐ": "vnd", "ki-lô-mét": "km", "Ha": "ha", "bộ": None}
    got = {r.t: r.u for r in spark.createDataFrame([(k,) for k in units], "t string").withColumn("u", unit_of(tx.fold(F.col("t")))).collect()}
    assert got == units
    names = {"Chiều dài – đơn vị mét dài": "m", "Khối lượng, 100m3": "100m3", "Thành tiền (VND)": "vnd", "Diện tích ［ｍ²］": "m2", "Ghi chú": None, "Khối lượng dài": None}
    got = {r.t: r.u for r in spark.createDataFrame([(k,) for k in names], "t string").withColumn("u", unit_in_name(tx.fold(F.col("t")))).collect()}
    assert got == names
