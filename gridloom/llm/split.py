"""Splitting oversized items at natural boundaries (problem 1).

Balanced targets: the least number of pieces that the limit and the overlap allow is computed,
equal-length targets are placed, each is snapped to the strongest boundary near it, and pieces are
added when a limit fails or when only weak boundaries were in reach.  The cuts are found in an
Arrow UDF over oversized texts only; the pieces themselves are cut by Spark's ``substring``.

Defined results for odd input:

* an item of ``max_chars`` code points or fewer, a null text and an item without a limit is one
  item as it is and gives no piece here;
* every piece has at most ``max_chars`` code points; piece k+1 begins exactly ``overlap_chars``
  code points before the end of piece k, so that the texts join again without loss;
* text without any boundary is cut between characters, never between a letter and its accent or
  within CR LF, unless a single cluster exceeds the limit;
* an overlap of ``max_chars`` or more is lowered to half of ``max_chars``; null counts as 0;
* of repeated rows of one item the latest holds, of equally late ones the longest.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strength of a boundary, strongest first.
NODE_END, HEADING, PARAGRAPH, TABLE_ROW, SENTENCE, SEMICOLON, CLAUSE, LINE, SPACE, ANY = 9, 8, 7, 6, 5, 4, 3, 2, 1, 0
_BOUNDARIES = (
    (CLAUSE, re.compile(r"[;,:、；：](?:\s+|(?<=[、；：]))")),
    (LINE, re.compile(r"\r\n|[\n\r ]")),
    (SENTENCE, re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』）]*)\s?")),
    (TABLE_ROW, re.compile(r"\|[ \t]*(?:\r\n|\n)(?=[ \t]*\|)|(?:\r\n|\n)(?=[ \t]*(?:[-*•]|\d+[.)])[ \t])")),
    (PARAGRAPH, re.compile(r"(?:\r\n|\n)[ \t]*(?:\r\n|\n)\s*")),
    (HEADING, re.compile(r"(?:\r\n|\n)(?=#{1,6} )")),
)
_SPACE = re.compile(r"\s+")
#: Characters that belong to the one before them: accents, joiners, the line feed of CR LF.
_GLUED = re.compile("(?<=\r)\n|[\u200d\ufe0f" + "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))) + "]|(?<=\u200d).")
CUTS_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "stop", "strength")]))


def boundaries(text: str, node_lengths: list[int] | None = None, separator: int = 2) -> np.ndarray:
    """Strength of a cut before each code point; -1 where no cut may lie (0 is between any two)."""
    strength = np.zeros(len(text) + 1, np.int8)
    for m in _SPACE.finditer(text):
        strength[m.end()] = SPACE
    for level, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            strength[m.end()] = max(level, strength[m.end()])
    at = 0
    for n in node_lengths[:-1] if node_lengths is not None else ():
        at += n + separator
        if 0 < at < len(text):
            strength[at] = NODE_END
    for m in _GLUED.finditer(text):
        if strength[m.end() - 1] == ANY:
            strength[m.end() - 1] = -1
    return strength


def _place(strength: np.ndarray, n: int, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """n - 1 cuts as (position, strength), or None where a limit fails."""
    length, step = len(strength) - 1, (len(strength) - 1 - overlap) / n
    radius = max(1, int(step * 0.3))
    cuts, before = [], 0
    for k in range(1, n):
        target = overlap + round(step * k) if n > 1 else length
        room = limit if k == 1 else before + limit - overlap
        low = max(target - radius, length - (n - k) * (limit - overlap), before + 1, overlap + 1)
        high = min(target + radius, room, length - 1)
        if low > high:
            return None
        window = strength[low : high + 1].astype(np.int64)
        away = np.abs(np.arange(low, high + 1) - target)
        best = int(np.argmax(window * (length + 1) - away))
        if window[best] < 0 and high - low > 0:
            return None
        before = low + best
        cuts.append((before, max(0, int(window[best]))))
    return cuts if length - before + overlap <= limit else None


def find_cuts(text: str, limit: int, overlap: int, node_lengths: list[int] | None = None) -> list[dict]:
    """Pieces [start, stop) of a text, each within the limit."""
    length = len(text)
    if length <= limit:
        return [{"start": 0, "stop": length, "strength": NODE_END}]
    overlap = overlap if 0 <= overlap < limit else limit // 2
    strength = boundaries(text, node_lengths)
    least = max(2, math.ceil((length - overlap) / (limit - overlap)))
    best = None
    for n in range(least, length + 1):
        cuts = _place(strength, n, limit, overlap)
        if cuts is not None:
            weak = sum(s < SEMICOLON for _, s in cuts)
            if best is None or weak < best[0]:
                best = (weak, cuts)
        # one or two more pieces are worth a natural boundary; after that the first that fits holds
        if best is not None and (best[0] == 0 or n >= least + 2):
            break
        if best is None and n > least + 2 and n >= 2 * (length - overlap) / max(1, limit - overlap):
            break
    if best is None:  # clusters longer than the limit leave no room: cut at the limit itself
        at, cuts = limit, []
        while at < length:
            cuts.append((at, ANY))
            at += limit - overlap
        best = (0, cuts)
    ends = [*best[1], (length, NODE_END)]
    starts = [0, *(c - overlap for c, _ in best[1])]
    return [{"start": a, "stop": b, "strength": s} for a, (b, s) in zip(starts, ends, strict=True)]


def _cuts_of(text: pd.Series, node_lengths: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([find_cuts(t, int(m), int(o), None if n is None else [int(x) for x in n]) for t, n, m, o in zip(text, node_lengths, limit, overlap, strict=True)])


# else the optimizer copies it into a filter before the explosion and runs it twice
_cuts = F.pandas_udf(_cuts_of, CUTS_TYPE).asNondeterministic()


def section_items(sections: DataFrame) -> DataFrame:
    """Sections as items: node texts that are neither null nor blank, joined by two line feeds."""
    texts = F.filter(F.transform("nodes", lambda n: n["text"]), lambda t: t.isNotNull() & t.rlike(r"(?U)[^\s\p{Z}]"))
    return sections.where("section_id IS NOT NULL").select(
        F.lit("section").alias("item_kind"),
        F.col("section_id").cast("string").alias("item_id"),
        F.array_join(texts, "\n\n").alias("text"),
        F.transform(texts, F.length).alias("node_lengths"),
        F.col("loaded_at").cast("timestamp_ntz").alias("as_of"),
    )


def markdown_items(document_summary: DataFrame) -> DataFrame:
    return document_summary.where("id IS NOT NULL AND markdown IS NOT NULL").select(
        F.lit("markdown").alias("item_kind"),
        F.col("id").alias("item_id"),
        F.col("markdown").alias("text"),
        F.lit(None).cast("array<int>").alias("node_lengths"),
        F.col("processed_at").cast("timestamp_ntz").alias("as_of"),
    )


def split_plans(items: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Oversized items with the array ``cuts`` of their pieces.

    ``size_limits`` has one row per item kind.  Texts within the limit are filtered out before
    anything moves or enters Python.
    """
    limits = size_limits.where("item_kind IS NOT NULL AND max_chars > 0").groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.coalesce(F.max("overlap_chars"), F.lit(0)).alias("overlap_chars"))
    rows = items.select("item_kind", "item_id", "text", "node_lengths", "as_of").join(limits, "item_kind").where("text IS NOT NULL")
    # the latest row of each item holds, whatever its length; only oversized texts move
    over = F.length("text") > F.col("max_chars")
    order = F.struct(F.coalesce("as_of", F.lit("0001-01-01").cast("timestamp_ntz")), F.length("text"), F.xxhash64("text"))
    thin = rows.select("item_kind", "item_id", order.alias("order"), F.when(over, F.struct("text", "node_lengths", "max_chars", "overlap_chars")).alias("item"))
    held = thin.groupBy("item_kind", "item_id").agg(F.max_by("item", "order").alias("held")).where("held IS NOT NULL").select("item_kind", "item_id", "held.*")
    return held.withColumn("cuts", _cuts("text", "node_lengths", "max_chars", "overlap_chars"))


def split_oversized(items: DataFrame, size_limits: DataFrame) -> DataFrame:
    """Ordered pieces: item_kind, item_id, piece_no, n_pieces, start_char, end_char, cut_strength, text."""
    return split_plans(items, size_limits).select("item_kind", "item_id", "text", F.size("cuts").alias("n_pieces"), F.posexplode("cuts").alias("piece_no", "cut")).select(
        "item_kind",
        "item_id",
        "piece_no",
        "n_pieces",
        F.col("cut.start").alias("start_char"),
        F.col("cut.stop").alias("end_char"),
        F.col("cut.strength").alias("cut_strength"),
        F.expr("substring(text, cut.start + 1, cut.stop - cut.start)").alias("text"),
    )


def rejoined(pieces: DataFrame) -> DataFrame:
    """item_kind, item_id, text, longest: the items put together again from their pieces, without the overlaps."""
    before = F.lag("end_char").over(Window.partitionBy("item_kind", "item_id").orderBy("piece_no"))
    own = pieces.withColumn("shared", F.coalesce(before, F.lit(0)) - F.col("start_char"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(text, shared + 1)").alias("text"))))
    return own.groupBy("item_kind", "item_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.max(F.length("text")).alias("longest"))
