"""Column-level clean-up of a frame: names, filters, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from ledgerfield.functions.keys import contains_pattern, is_uuid
from ledgerfield.operators.quantiles import medians


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def clean_headers(df: DataFrame, spaces_to_underscore: bool = True) -> DataFrame:
    names = [c.strip().lower() for c in df.columns]
    if spaces_to_underscore:
        names = [c.replace(" ", "_") for c in names]
    return df.toDF(*names)


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns the frame lacks."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def fill_constant(df: DataFrame, value=0) -> DataFrame:
    """Fill nulls in the columns whose type matches the value."""
    return df.na.fill(value)


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """Fill nulls with the exact median of the whole column, of any size."""
    if column not in df.columns:
        return df
    median = medians(df, [column]).getField(column)
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), median))


def equals_ignoring_case(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Filter skipped when no value is given."""
    if not value:
        return df
    return df.where(F.lower(column) == value.strip().lower())


def equals_flag(df: DataFrame, column: str, value: bool | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == int(value))


def matches_pattern(df: DataFrame, column: str, pattern: str | None) -> DataFrame:
    if not pattern or column not in df.columns:
        return df
    return df.where(contains_pattern(F.col(column), pattern))


def keep_valid_uuid(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_uuid(F.col(column)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
