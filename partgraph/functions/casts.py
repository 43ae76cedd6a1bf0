"""Lenient type conversions: a value that does not convert becomes null, nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number spellings the JVM accepts but the data format does not: ``1d``, ``2.5F``, ``0x1p3``.
_JVM_ONLY_NUMBER = r"(?i)[0-9.][df]\s*$|x"


def to_int64(col: Column) -> Column:
    """Nullable bigint. Text must be a whole number; fractions of numeric columns are cut off."""
    return col.try_cast("bigint")


def to_string(col: Column) -> Column:
    return col.cast("string")


def round2(col: Column) -> Column:
    """Two decimals, ties to even. Past 2^53 hundredths a double has no decimals left to round."""
    return F.when(F.abs(col) < 9.0e13, F.rint(col * 100) / 100).otherwise(col)


def to_float2(col: Column) -> Column:
    """Nullable double with two decimals."""
    number = F.when(~col.cast("string").rlike(_JVM_ONLY_NUMBER), col).try_cast("double")
    return round2(number)
