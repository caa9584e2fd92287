"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def present(value: Column) -> Column:
    return value.isNotNull().cast("int")


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Hold a value in a range; null stays null (bare greatest/least skip nulls)."""
    held = value
    if high is not None:
        held = F.least(held, F.lit(high))
    if low is not None:
        held = F.greatest(held, F.lit(low))
    return F.when(value.isNotNull(), held)


def safe_divide(numerator: Column, denominator: Column, default=0.0) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")),
                      F.lit(default))


def clipped_ratio(numerator: Column, denominator: Column, low: float, high: float,
                  default: float = 0.0) -> Column:
    ratio = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(clip(ratio, low, high), F.lit(default))


def log1p_floored(value: Column) -> Column:
    return F.log1p(clip(value.cast("double"), low=0.0))


def round_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


def rate_pct(flag_column: Column, places: int = 2) -> Column:
    """Mean of a 0/1 flag as a rounded percentage (an aggregate)."""
    return F.bround(F.avg(flag_column) * 100, places)


def sorted_fraction(count: Column, total: Column, places: int = 1) -> Column:
    return F.bround(F.try_divide(count * 100.0, total), places)
