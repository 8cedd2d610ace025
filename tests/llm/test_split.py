from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import split

LIMITS = "item_kind string, max_chars int, overlap_chars int"
ITEMS = "item_kind string, item_id string, text string, node_lengths array<int>, as_of timestamp_ntz"


def check(text, limit, overlap, lengths=None):
    pieces = split.find_cuts(text, limit, overlap, lengths)
    assert all(0 < p["stop"] - p["start"] <= limit for p in pieces)
    assert pieces[0]["start"] == 0 and pieces[-1]["stop"] == len(text)
    assert all(b["start"] == a["stop"] - overlap for a, b in zip(pieces, pieces[1:]))
    return pieces


@pytest.mark.parametrize("seed", range(12))
def test_random_texts_join_again(seed):
    rng = random.Random(seed)
    words = ["tường", "a", "bê tông.", "x; y", "\n\n", "\n| a | b |", "\n# T\n", "1,5 m².", "́", "\r\n", "屋上防水。"]
    text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 900)))
    limit = rng.randint(30, 300)
    overlap = rng.randint(0, limit // 3)
    pieces = check(text, limit, overlap)
    assert text[pieces[0]["start"] : pieces[0]["stop"]] + "".join(text[a["stop"] : b["stop"]] for a, b in zip(pieces, pieces[1:])) == text


def test_boundaries_by_strength():
    paragraphs = ("Một câu dài. " * 6).strip()
    text = "\n\n".join([paragraphs] * 8)
    assert all(p["strength"] >= split.PARAGRAPH for p in check(text, 200, 20)[:-1])
    lengths = [len(paragraphs)] * 8
    assert all(p["strength"] == split.NODE_END for p in check(text, 200, 20, lengths)[:-1])
    rows = "\n".join("| 1 | cát vàng | 5,1 |" for _ in range(100))
    assert all(p["strength"] == split.TABLE_ROW for p in check(rows, 300, 30)[:-1])
    sentences = " ".join(f"Câu số {i} có dấu, và thêm phần sau." for i in range(80))
    assert all(p["strength"] == split.SENTENCE for p in check(sentences, 300, 30)[:-1])


def test_pieces_are_balanced_and_few():
    text = " ".join("từ" for _ in range(4000))
    pieces = check(text, 2000, 200)
    assert len(pieces) == -(-(len(text) - 200) // 1800)
    sizes = [p["stop"] - p["start"] for p in pieces]
    assert max(sizes) - min(sizes) < 400


@pytest.mark.parametrize("text", ["x" * 5000, "é" * 700, "\r\n" * 500, "́" * 300])
def test_hard_texts(text):
    pieces = check(text, 100, 10)
    if "\r" in text:
        assert all(text[p["stop"] - 1 : p["stop"] + 1] != "\r\n" for p in pieces[:-1])


def test_accents_stay_with_their_letter():
    text = "é" * 700
    assert all(text[p["stop"]] != "́" for p in check(text, 100, 10)[:-1])


def test_odd_limits():
    assert split.find_cuts("abc", 5, 2) == [{"start": 0, "stop": 3, "strength": split.NODE_END}]
    assert all(p["stop"] - p["start"] <= 10 for p in split.find_cuts("a b " * 30, 10, 10))
    assert all(p["stop"] - p["start"] <= 1 for p in split.find_cuts("abcd", 1, 0))


def test_operator(spark):
    long = "Một câu. " * 60
    items = [("section", "1", long, [len(long)], None), ("section", "1", long, [len(long)], None), ("section", "2", "short", [5], None), ("section", "3", None, None, None), ("other", "4", long, None, None), ("markdown", "5", "x" * 101, None, None), (None, "6", long, None, None)]
    limits = spark.createDataFrame([("section", 100, 10), ("markdown", 100, None), ("none", None, None)], LIMITS)
    df = spark.createDataFrame(items, ITEMS).withColumns({"max_chars": F.lit(1), "cuts": F.lit("x"), "n_pieces": F.lit(0)})
    pieces = split.split_oversized(df, limits).orderBy("item_id", "piece_no").collect()
    assert {r.item_id for r in pieces} == {"1", "5"}
    one = [r for r in pieces if r.item_id == "1"]
    assert [r.piece_no for r in one] == list(range(one[0].n_pieces)) and all(len(r.text) <= 100 for r in one)
    assert one[0].text + "".join(r.text[10:] for r in one[1:]) == long
    assert split.split_oversized(df.limit(0), limits).count() == 0 and split.split_oversized(df, limits.limit(0)).count() == 0


def test_latest_row_holds_whatever_its_length(spark):
    early, late = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
    items = [("section", "1", "x" * 300, None, early), ("section", "1", "short", None, late), ("section", "2", "short", None, early), ("section", "2", "y" * 300, None, late)]
    items += [("section", "3", "z" * 200, None, late), ("section", "3", "z" * 300, None, late), ("section", "3", "z", None, None)]
    limits = spark.createDataFrame([("section", 100, 10)], LIMITS)
    plans = {r.item_id: r.text for r in split.split_plans(spark.createDataFrame(items, ITEMS), limits).collect()}
    assert plans == {"2": "y" * 300, "3": "z" * 300}


def test_items(spark):
    schema = "section_id bigint, nodes array<struct<kind:string,text:string>>, loaded_at timestamp_ntz"
    nodes = [("Paragraph", " a"), ("Paragraph", "  "), ("Fragment", None), ("Table", "| x |")]
    rows = spark.createDataFrame([(1, nodes, None), (2, [], None), (3, None, None), (None, nodes, None)], schema)
    got = {r.item_id: (r.text, r.node_lengths) for r in split.section_items(rows).collect()}
    assert got["1"] == (" a\n\n| x |", [2, 5]) and got["2"] == ("", []) and set(got) == {"1", "2", "3"}
