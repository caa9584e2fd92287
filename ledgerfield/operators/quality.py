"""Checks of a frame. Facts are checked in one pass; nothing raises unless asked to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerfield.operators.aggregates import rows_from_one


class ValidationError(ValueError):
    """A frame does not meet its checks."""


@dataclass(frozen=True)
class Check:
    name: str
    violations: Column  # an aggregate
    severity: str = "error"


def require_columns(df: DataFrame, columns: list[str]) -> bool:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"Missing required columns: {missing}")
    return True


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return rows_from_one(one, [[("column", F.lit(c)), ("nulls", F.col(c))] for c in columns])


def require_no_nulls(df: DataFrame, columns: list[str]) -> bool:
    bad = [r["column"] for r in null_counts(df, columns).where("nulls > 0").collect()]
    if bad:
        raise ValidationError(f"Null values found in {bad}")
    return True


def not_null(column: str) -> Check:
    return Check(f"{column} has no nulls", F.count_if(F.col(column).isNull()))


def unique(column: str) -> Check:
    return Check(f"{column} is unique", F.count("*") - F.count_distinct(column))


def in_values(column: str, values: list) -> Check:
    ok = F.coalesce(F.col(column).isin(values), F.lit(False))
    return Check(f"{column} in {values}", F.count_if(~ok))


def in_range(column: str, low: float, high: float) -> Check:
    ok = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return Check(f"{column} between {low:g} and {high:g}", F.count_if(~ok))


def not_negative(column: str) -> Check:
    return Check(f"{column} is not negative", F.count_if(F.col(column) < 0))


def at_most(column: str, high: float) -> Check:
    return Check(f"{column} at most {high:g}", F.count_if(F.col(column) > high))


def not_empty_text(column: str, severity: str = "warn") -> Check:
    return Check(f"{column} is not empty", F.count_if(F.col(column) == ""), severity)


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """(check, severity, violations, passed) for every check."""
    one = df.agg(*[c.violations.cast("bigint").alias(f"v{i}") for i, c in enumerate(checks)])
    return rows_from_one(one, [
        [("check", F.lit(c.name)), ("severity", F.lit(c.severity)),
         ("violations", F.col(f"v{i}")), ("passed", F.col(f"v{i}") == 0)]
        for i, c in enumerate(checks)])


def passes(report: DataFrame) -> bool:
    """True when no check of severity error is violated."""
    return report.where("severity = 'error' AND NOT passed").isEmpty()


def date_order_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    """How often the first date lies after, on and before the second."""
    a, b = F.col(first), F.col(second)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(a > b).alias("sale_after_install"),
        F.count_if(a == b).alias("sale_equals_install"),
        F.count_if(a < b).alias("sale_before_install"),
    )
