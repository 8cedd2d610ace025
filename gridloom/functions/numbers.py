"""Numbers written in Vietnamese, English and scanned forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.once import once


def _one_separator(text: Column, separator: str) -> Column:
    """Digits with one kind of separator: decimal if it stands once with at most two bytes after it."""
    parts = F.split(text, f"[{separator}]", -1)
    last = F.element_at(parts, -1)
    decimal = (F.size(parts) == 2) & (F.octet_length(last) <= 2)
    return F.when(decimal, F.regexp_replace(text, f"[{separator}]", ".")).otherwise(F.regexp_replace(text, f"[{separator}]", ""))


def sanitize_number(raw: Column) -> Column:
    """A noisy number as DOUBLE, null where there is none.

    Brackets around or a minus before make it negative; l, I, O, o and S are read as digits; of two
    kinds of separators the last is the decimal one; only ordinary spaces may stand inside.
    """
    return once(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), _signed)


def _signed(text: Column) -> Column:
    digits = F.translate(F.regexp_replace(text, r"^[()\[\]-]+|[()\[\]-]+$", ""), "lIOoS", "11005")
    value = once(once(F.regexp_replace(digits, r"(?U)[^\d.,\s]", ""), _separators), _as_double)
    return F.when((text.startswith("(") & text.endswith(")")) | text.startswith("-"), -value).otherwise(value)


def _separators(digits: Column) -> Column:
    comma, point = F.instr(F.reverse(digits), ","), F.instr(F.reverse(digits), ".")
    both = F.when(comma < point, F.translate(F.translate(digits, ".", ""), ",", ".")).otherwise(F.translate(digits, ",", ""))
    plain = F.when((comma > 0) & (point > 0), both).when(comma > 0, _one_separator(digits, ",")).when(point > 0, _one_separator(digits, ".")).otherwise(digits)
    return F.translate(plain, " ", "")


def _as_double(plain: Column) -> Column:
    return F.when(plain.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)\z"), plain.try_cast("double"))
