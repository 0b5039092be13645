"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_number(column: Column) -> Column:
    """The value as a double; text that is no number, and NaN, become null."""
    text = F.trim(column.cast("string"))
    # Java reads a trailing d or f as a type mark; plain number text has none.
    marked = text.rlike(r"[0-9.][dDfF]$")
    number = F.when(marked, None).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def feature_number(column: Column) -> Column:
    """The value as a double, 0 where it is missing."""
    double = column.cast("double")
    return F.coalesce(F.when(~F.isnan(double), double), F.lit(0.0))


def is_number(column: Column) -> Column:
    """True when the value is neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def argmax(values: Column) -> Column:
    """Position, from 0, of the first greatest value of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
