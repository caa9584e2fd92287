"""Dates without a time zone: raw values are wall-clock, so TIMESTAMP_NTZ is used throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MODES = ("signed", "clamp", "null_negative")


def parse_timestamp(value: Column, formats: list[str] | None = None) -> Column:
    """Lenient parse: a value that is no timestamp becomes null (ANSI casts would raise)."""
    text = F.trim(value.cast("string"))
    parsed = [text.try_cast("timestamp_ntz")]
    parsed += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats or []]
    return F.coalesce(*parsed)


def parse_date(value: Column, formats: list[str] | None = None) -> Column:
    return parse_timestamp(value, formats).cast("date")


def elapsed_days(end: Column, start: Column, mode: str = "signed") -> Column:
    """Whole elapsed days from start to end, rounded down.

    ``signed`` keeps negatives, ``clamp`` turns them into 0, ``null_negative`` into null.
    """
    if mode not in DAY_MODES:
        raise ValueError(f"mode must be one of {DAY_MODES}, not {mode!r}")
    end, start = end.cast("timestamp_ntz"), start.cast("timestamp_ntz")
    calendar = F.datediff(end, start)
    # The calendar difference is one too many when the end has not reached the start's time of day.
    short = (start + F.make_dt_interval(days=calendar)) > end
    days = calendar - short.cast("int")
    if mode == "clamp":
        return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))
    if mode == "null_negative":
        return F.when(days >= 0, days)
    return days


def calendar_days(end: Column, start: Column) -> Column:
    """Day boundaries crossed between two dates."""
    return F.datediff(end, start)


def month_start(value: Column) -> Column:
    return F.trunc(value.cast("date"), "month")


def quarter_start(value: Column) -> Column:
    return F.trunc(value.cast("date"), "quarter")


def quarter_label(value: Column) -> Column:
    """``2024-Q1``."""
    return F.concat(F.year(value).cast("string"), F.lit("-Q"), F.quarter(value).cast("string"))
