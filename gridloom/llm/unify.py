"""One consistent form of texts that look alike (problem 4).

The canonical form is the compatibility normalisation in composed form with full case folding,
every separator mapped to the ordinary space and default-ignorable characters removed; look-alike
letters of other scripts inside Latin words are read as the expected ones before.  Beside it a
clean form keeps case, superscripts and typographic signs and repairs only what cannot be seen.
Each distinct value of an Arrow batch is normalised once.

Defined results for odd input:

* null stays null and is no case; empty text stays empty;
* words wholly in another script with letters of their own (Greek, Cyrillic) stay as they are;
* Φ, Ø, µ, superscripts, fractions, quotes, dashes, case, tone position and line breaks are no case;
* both forms are idempotent.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import LOOKALIKES, ignorable_characters, ignorable_class, ignorable_table, space_table

#: Only inside a word with Latin letters: alone they are signs or letters of their own.
_IN_WORDS = {"ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t"}
_FOREIGN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_FULL_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0xFFE0: 0xA2, 0xFFE1: 0xA3, 0xFFE2: 0xAC, 0xFFE3: 0xAF, 0xFFE4: 0xA6, 0xFFE5: 0xA5}


@functools.cache
def _invisible() -> dict[int, str | int | None]:
    return {**ignorable_table(), **space_table(), **_FULL_WIDTH}


def _is_foreign(c: str) -> bool:
    return "Ͱ" <= c <= "Ͽ" or "Ѐ" <= c <= "ԯ" or "ἀ" <= c <= "῿"


def _latin(m: re.Match) -> str:
    word = m.group()
    if not any(c in LOOKALIKES or c in _IN_WORDS for c in word):
        return word
    latin = any(not _is_foreign(c) for c in word)
    if not latin and not all(c in LOOKALIKES for c in word if c.isalpha()):
        return word
    table = {**LOOKALIKES, **_IN_WORDS} if latin else LOOKALIKES
    return "".join(table.get(c, c) for c in word)


@functools.cache
def _odd() -> re.Pattern:
    """Characters that the clean form may change."""
    others = {*map(chr, {**space_table(), **_FULL_WIDTH}), *LOOKALIKES, *_IN_WORDS}
    return re.compile(f"[{ignorable_class()}{''.join(map(re.escape, sorted(others)))}]")


def clean_form(text: str) -> str:
    """The text with the expected characters; what can be seen stays as it is."""
    if text.isascii() or not _odd().search(text) and unicodedata.is_normalized("NFC", text):
        return text
    return _FOREIGN_WORD.sub(_latin, unicodedata.normalize("NFC", text.translate(_invisible())))


def canonical_form(text: str) -> str:
    """The form to compare by."""
    form = unicodedata.normalize("NFKC", clean_form(text)).casefold()
    return " ".join(unicodedata.normalize("NFKC", form).split())


UNIFY_TYPE = T.StructType([T.StructField("altered", T.BooleanType()), T.StructField("clean", T.StringType()), T.StructField("canonical", T.StringType())])


@F.pandas_udf(UNIFY_TYPE)
def unify_column(text: pd.Series) -> pd.DataFrame:
    codes, values = pd.factorize(text)
    done = [(c != v, c, canonical_form(v)) for v in values for c in (clean_form(v),)]
    return pd.DataFrame([*done, (False, None, None)], columns=["altered", "clean", "canonical"]).iloc[codes].reset_index(drop=True)


@F.pandas_udf(T.BooleanType())
def altered_column(text: pd.Series) -> pd.Series:
    codes, values = pd.factorize(text)
    return pd.Series(np.array([*(clean_form(v) != v for v in values), False], bool)[codes])


def field_texts(physical_rows: DataFrame, extracted_tables: DataFrame) -> DataFrame:
    """field, table_id, row_pos, cell_pos, text of all cells and column names."""
    cells = physical_rows.select(F.lit("raw_text").alias("field"), "table_id", F.col("row_pos").cast("int").alias("row_pos"), F.posexplode("cells").alias("cell_pos", "cell")).select("field", "table_id", "row_pos", "cell_pos", F.col("cell.raw_text").alias("text"))
    names = extracted_tables.select(F.lit("name").alias("field"), "table_id", F.lit(-1).alias("row_pos"), F.posexplode("columns").alias("cell_pos", "cell")).select("field", "table_id", "row_pos", "cell_pos", F.col("cell.name").alias("text"))
    return cells.unionByName(names)


def unified(texts: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``unified``: altered, clean, canonical."""
    return texts.withColumn("unified", unify_column(F.col(text)))


def altered_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose characters are not the expected ones; ASCII text does not enter Python."""
    return texts.where(F.col(text).rlike(r"[^\x00-\x7F]")).where(altered_column(F.col(text)))


#: For the SQL check: the characters of a case, as ranges of a regular expression.
def case_class() -> str:
    invisible = "".join(f"\\x{{{ord(c):X}}}" for c in ignorable_characters() if ord(c) < 0x10000)
    spaces = "".join(f"\\x{{{c:X}}}" for c in space_table())
    return "[" + invisible + spaces + r"\x{FF01}-\x{FF5E}\x{FFE0}-\x{FFE6}" + "".join(f"\\x{{{ord(c):X}}}" for c in LOOKALIKES) + "]"
