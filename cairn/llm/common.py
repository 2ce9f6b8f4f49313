"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Number of words; null counts as none."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def hex_bucket(key: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest column, as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def digits_for(rows: int, per_bucket: int = 20_000, most: int = 5) -> int:
    """How many hexadecimal digits split so many rows into buckets of about per_bucket rows."""
    digits = 1
    while digits < most and rows / 16**digits > per_bucket:
        digits += 1
    return digits
