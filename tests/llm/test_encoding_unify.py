from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import encoding, unify

TEXTS = ["Nạo vét bùn rãnh dọc bằng thủ công", "Đắp cát công trình độ chặt K90 tại khu xử lý nước", "CẦU THANG ÂU THUYỀN, LAN CAN GÃY KHÚC", "Béton armé de façade, côté cour n° 3 pour la station d'épuration", "鉄筋コンクリート基礎3（五号作業場）", "Cột đèn chiếu sáng cao 5,5 m – ≥ 3 m²"]


def sloppy(raw: bytes, page: str) -> str:
    return "".join(encoding._charmap(page)[1][b] for b in raw)


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("page", ["cp1252", "latin_1", "mac_roman", "cp437", "cp850"])
def test_utf8_read_wrongly(text, page):
    status, restored, _ = encoding.repair(sloppy(text.encode(), page))
    assert (status, restored) == ("restored", text)


@pytest.mark.parametrize("text", TEXTS[:4])
def test_nested_layers(text):
    twice = sloppy(sloppy(text.encode(), "cp1252").encode(), "cp1252")
    assert encoding.repair(twice)[:2] == ("restored", text)


def test_part_of_a_text():
    text = TEXTS[1]
    assert encoding.repair(sloppy(text[:14].encode(), "cp1252") + text[14:])[1] == text


def to_tcvn3(text: str) -> str:
    back = {v: k for k, v in encoding._tcvn3().items()}
    return "".join(back.get(c, back.get(c.lower(), c)) for c in text)


def to_vni(text: str) -> str:
    marks = {tuple(sorted(unicodedata.normalize("NFD", v))): k for k, v in encoding._VNI_MARKS.items()}
    letters = {v: k for k, v in encoding._VNI_LETTERS.items()}
    out = []
    for c in text:
        low = c.lower()
        if low in letters:
            out.append(letters[low] if c == low else letters[low].upper())
            continue
        parts = unicodedata.normalize("NFD", low)
        base, rest = parts[0], list(parts[1:])
        if "̛" in rest:
            rest.remove("̛")
            base = {"o": "ô", "u": "ö"}[base]
        out.append((base if c == low else base.upper()) + (marks[tuple(sorted(rest))] if rest else ""))
    return "".join(out)


@pytest.mark.parametrize("text", TEXTS[:2])
def test_legacy_fonts(text):
    assert encoding.repair(to_tcvn3(text))[:2] == ("restored", text)
    assert encoding.repair(to_vni(text))[:2] == ("restored", text)


@pytest.mark.parametrize("text", ["http://a.b/c?x=1", "id?name", "Is this ok?yes", "Really ??", "?type", "Ãà"])
def test_little_evidence_is_none(text):
    assert encoding.repair(text)[0] == ""


@pytest.mark.parametrize("text", ["Thép hìrih I80 mạ nóng", "tại pliân khu phía Đông", "Ex¢avation in soft ground, depth 2 m²", "Béton armé de façade, côté ¢our"])
def test_scan_noise_is_no_garbling(text):
    assert encoding.repair(text) == ("", None, None)


def test_little_text_in_a_legacy_font():
    assert encoding.repair("xem phuï luïc")[:2] == ("restored", "xem phụ lục")
    assert encoding.repair("ouï, inouï")[0] == ""


@pytest.mark.parametrize("text", ["Steel pipe ?240 mm, 45? bend", "ph?n móng", "B?I ??T", "n??c", "L?p d?ng", "5 m?, cao", "fa?ade du b?timent"])
def test_lost_letters(text):
    assert encoding.repair(text) == ("lost", None, None)


def to_cp1258(text: str) -> bytes:
    out = b""
    for c in text:
        try:
            out += c.encode("cp1258")
        except UnicodeEncodeError:
            parts = unicodedata.normalize("NFD", c)
            tone = [m for m in parts[1:] if m in "̣̀́̃̉"]
            letter = unicodedata.normalize("NFC", parts[0] + "".join(m for m in parts[1:] if m not in tone))
            out += letter.encode("cp1258") + "".join(tone).encode("cp1258")
    return out


def test_windows_vietnamese_and_others():
    assert encoding.repair(sloppy(to_cp1258(TEXTS[0]), "cp1252"))[:2] == ("restored", TEXTS[0])
    assert encoding.repair(sloppy(TEXTS[3].encode("cp1252"), "cp850"))[:2] == ("restored", TEXTS[3])
    assert encoding.repair(sloppy(TEXTS[4].encode("cp932"), "cp1252"))[:2] == ("restored", TEXTS[4])


@pytest.mark.parametrize("text", ["t?m t?nh", "C���t", "Ph� ki�n", "?ào móng"])
def test_lost(text):
    assert encoding.repair(text)[0] in ("lost", "partial")


@pytest.mark.parametrize("text", [*TEXTS, "", "   ", "Why? Because.", "Có đúng không?", "Réseau d’évacuation Ø40", "Maçonnerie légère « creuse » dosée à 240 kg/m³", "Tủ điện 200A ½ mô-đun", "1.647,07tr.đ", "Cộт đèn", "ｍ²", "tbép hình I70", "gạ¢h ống", "x" * 100_000, "ấ" * 5000])
def test_clean_texts_stay(text):
    assert encoding.repair(text)[0] == ""


def test_garbled_rows(spark):
    bad = sloppy(TEXTS[0].encode(), "cp1252")
    rows = [("a", bad), ("a", bad), ("b", TEXTS[0]), ("c", None), ("d", ""), ("e", "t?m t?nh"), (None, bad)]
    df = spark.createDataFrame(rows, "global_id string, source_text string").withColumn("status", F.lit("mine"))
    got = encoding.garbled_texts(df).select("global_id", "status", "encoding_repair.*").drop("status").distinct().collect()
    assert {(r.global_id, r.restored) for r in got} == {("a", TEXTS[0]), ("e", None), (None, TEXTS[0])}
    assert encoding.garbled_texts(df.limit(0)).count() == 0


# ---------------------------------------------------------------- look-alikes

ALTERED = {"Hạng mục": "Hạng mục", "Ηạnɡ mục": "Hạng mục", "Diện tíсh": "Diện tích", "Ｋｇ": "Kg", "m＾２": "m^2", "Ghi chú": "Ghi chú", "t​ấn﻿": "tấn", "СТТ": "CTT", "Ðơn vị": "Đơn vị", "Κɡ": "Kg"}
UNALTERED = ["m²", "Ø20", "Φ90 nối", "½ mô-đun", "µm ±3", "“type 6”", "hoà – hòa", "a  b\nc", "HẠNG MỤC", "Москва", "αβγ", "x5ung", "", "45° ≥ 3"]


def test_clean_form():
    assert {k: unify.clean_form(k) for k in ALTERED} == ALTERED
    assert [unify.clean_form(t) for t in UNALTERED] == UNALTERED


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_forms_are_idempotent(text):
    clean = unify.clean_form(text)
    assert unify.clean_form(clean) == clean
    form = unify.canonical_form(text)
    assert unify.canonical_form(form) == form


def test_canonical_form_makes_alike_equal():
    assert len({unify.canonical_form(t) for t in ("Hạng mục", "HẠNG MỤC", "Hạng mục", "Ηạnɡ​ mục", "Ｈạng  mục")}) == 1


def test_unified_rows(spark):
    rows = spark.createDataFrame([("t", 0, [("a", 1.0), (None, None), ("Κɡ", None)], "x")] * 2 + [("t", None, None, "x"), (None, 1, [], "x")], "table_id string, row_pos int, cells array<struct<raw_text:string,numeric_value:double>>, text string")
    names = spark.createDataFrame([("t", [("Ðơn vị",), (None,)]), ("u", None)], "table_id string, columns array<struct<name:string>>")
    texts = unify.field_texts(rows, names)
    got = unify.altered_texts(texts).select("field", "table_id", "row_pos", "cell_pos").distinct().collect()
    assert {tuple(r) for r in got} == {("raw_text", "t", 0, 2), ("name", "t", -1, 0)}
    assert unify.unified(texts).where("text IS NULL AND unified.clean IS NULL").count() == 3
    assert unify.altered_texts(texts.limit(0)).count() == 0
