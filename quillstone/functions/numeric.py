"""Null-safe arithmetic and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null if either is missing or b is 0."""
    return F.try_divide(a, b)


def percent(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) * 100


def change(now: Column, before: Column) -> Column:
    """Percent change against the size of the earlier value, so a smaller loss is a rise."""
    return F.try_divide(now - before, F.abs(before)) * 100


def growth_rate(first: Column, last: Column, years: Column) -> Column:
    """Compound annual growth in percent; null unless both values and the span are positive."""
    return F.when((first > 0) & (last > 0) & (years > 0), (F.pow(last / first, F.lit(1.0) / years) - 1) * 100)


def number_text(v: Column) -> Column:
    """Grouped digits: none after the point for whole numbers from 100 on, else two."""
    return F.when(v.isNull(), "Not available").when((F.abs(v) >= 100) & (v == F.floor(v)), F.format_number(v, 0)).otherwise(F.format_number(v, 2))


def ratio_text(v: Column, unit: str) -> Column:
    return F.when(v.isNull(), "Not available").otherwise(F.concat(F.format_number(v, 2), F.lit(unit)))


def change_text(v: Column, unit: str) -> Column:
    return F.when(v.isNull(), "Not available").otherwise(F.concat(F.when(v > 0, "+").otherwise(""), F.format_number(v, 2), F.lit(unit)))
