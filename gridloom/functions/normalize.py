"""Normalisers of headers, units, numbers and nulls, and small text functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^\s+|\s+$"


def accent_pairs() -> tuple[str, str]:
    """Small accented Vietnamese letters beside their plain ones, built by rule from vowels, hats and tones."""
    source, target = ["đ"], ["d"]
    for base, hats in {"a": ["", "̆", "̂"], "e": ["", "̂"], "i": [""], "o": ["", "̂", "̛"], "u": ["", "̛"], "y": [""]}.items():
        for hat in hats:
            for tone in ["", "̀", "̉", "̃", "́", "̣"]:
                letter = unicodedata.normalize("NFC", base + hat + tone)
                if letter != base:
                    source.append(letter)
                    target.append(base)
    return "".join(source), "".join(target)


def trim_all(text: Column) -> Column:
    """Trim every Unicode white space."""
    return F.regexp_replace(text, _EDGE, "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def normalize_header(raw: Column) -> Column:
    """Trimmed, small, without Vietnamese accents, white space as one underscore."""
    return F.regexp_replace(F.translate(F.lower(trim_all(raw)), *accent_pairs()), r"(?U)\s+", "_")


def normalize_number(value: Column) -> Column:
    """To three decimals, half away from zero on the product; not the same as rounding to three digits."""
    return F.round(value * 1000) / 1000


#: Unit names that are unified; all others have no unit.
UNITS = {"m2": "m²", "mét vuông": "m²", "m3": "m³", "mét khối": "m³", "cái": "cái", "bộ": "bộ", "kg": "kg", "tan": "tấn", "tấn": "tấn"}


def normalize_unit(raw: Column) -> Column:
    text = F.lower(trim_all(raw))
    out = F.lit(None).cast("string")
    for name, unit in UNITS.items():
        out = F.when(text == name, unit).otherwise(out)
    return out


def normalize_null(raw: Column) -> Column:
    """A tagged cell value: blank and "-" are null, "0" is the number 0, all else stays text."""
    text = trim_all(raw)
    tag = F.when((text == "") | (text == "-"), "Null").when(text == "0", "Float").otherwise("Text")
    return F.when(raw.isNotNull(), F.struct(tag.alias("tag"), F.when(text == "0", 0.0).alias("f"), F.when(tag == "Text", text).alias("s")))


def extension(path: Column) -> Column:
    """Small extension of a path's file name, '' without one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def global_id(table_id: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("_", table_id, row, col)


def progress_percent(current: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * current / total)).otherwise(0.0)


def mapped(value: Column, names: dict[str, str]) -> Column:
    """Closed look-up, null for other values."""
    out = F.lit(None).cast("string")
    for key, name in names.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def unknown_share(text: Column) -> Column:
    """Share of replacement characters in a text."""
    return F.when(F.length(text) > 0, (F.length(text) - F.length(F.translate(text, "�", ""))) / F.length(text)).otherwise(0.0)
