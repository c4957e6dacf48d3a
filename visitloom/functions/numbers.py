"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a report may call a number. Java's parser would also take '1d' or '0x1p3'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL on a zero denominator."""
    return F.try_divide(part, whole)


def share_of_rows(condition: Column) -> Column:
    """Aggregate: share of the rows on which ``condition`` holds."""
    return ratio(F.count_if(condition), F.count(F.lit(1)))


def percent_change(current: Column, previous: Column) -> Column:
    return ratio(current - previous, previous) * 100


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """NULL for a constant group and for a group of one row."""
    return ratio(value - mean, deviation)


def whole_number(text: Column) -> Column:
    """Text to a whole number: truncated toward zero, 0 where it is not a number."""
    parsed = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")).try_cast("bigint")
    return F.coalesce(parsed, F.lit(0).cast("bigint"))
