"""Identities: stable ids, row hashes and how 64-bit values are written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Multiplier and rotation of the row hash; fixed values.
MIX, ROTATION = 0x517CC1B727220A95, 5


def stable_id(context: Column, content: Column) -> Column:
    """64-bit id of a content in its context; the two never run into each other, null counts as ''."""
    return F.xxhash64(F.coalesce(context, F.lit("")), F.coalesce(content, F.lit("")))


def hex_padded(value: Column) -> Column:
    """Sixteen hexadecimal digits of the bit pattern."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hex_plain(value: Column) -> Column:
    return F.lower(F.hex(value))


def unsigned(value: Column) -> Column:
    """The bit pattern as an unsigned decimal text."""
    return F.conv(F.hex(value), 16, 10)


@F.pandas_udf(T.LongType())
def row_hash(section_id: pd.Series, table_id: pd.Series, row_idx: pd.Series) -> pd.Series:
    """Wrapping 64-bit mix of a row's place, for the rows of a report only (joins use the plain key)."""
    a, b, c = (s.fillna(0).to_numpy(np.int64).view(np.uint64) for s in (section_id, table_id, row_idx))
    with np.errstate(over="ignore"):
        h = a * np.uint64(MIX) + b
        h = (h << np.uint64(ROTATION)) | (h >> np.uint64(64 - ROTATION))
        h = h * np.uint64(MIX) + c
    return pd.Series(h.view(np.int64))


@F.pandas_udf(T.StringType())
def two_decimals(value: pd.Series) -> pd.Series:
    """A double to two decimals by its exact binary value; Spark's own format rounds its shortest text."""
    return pd.Series([None if v != v else "%.2f" % v for v in value.to_numpy(float, na_value=np.nan).tolist()], dtype=object)
