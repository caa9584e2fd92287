"""Ages, tenures and their buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerfield.functions.dates import elapsed_days


def bucket(value: Column, upper_edges: list[tuple[float, str]], lowest: float,
           include_lowest: bool = False) -> Column:
    """Label of the right-closed bin holding the value; null outside all bins."""
    above = value >= lowest if include_lowest else value > lowest
    label = None
    for edge, name in upper_edges:
        label = F.when(value <= edge, name) if label is None else label.when(value <= edge, name)
    return F.when(above, label)


def age_by_calendar_year(birth: Column, reference: Column) -> Column:
    """Difference of calendar years, 0 when the birth date is missing."""
    return F.coalesce(F.year(reference) - F.year(birth), F.lit(0))


def age_by_days(birth: Column, reference: Column) -> Column:
    """Elapsed days / 365.25, held within 18 to 90 and rounded half to even; null stays null."""
    years = elapsed_days(reference, birth) / F.lit(365.25)
    held = F.when(years.isNotNull(), F.greatest(F.least(years, F.lit(90.0)), F.lit(18.0)))
    return F.rint(held).cast("int")


def age_bucket_adult(age: Column) -> Column:
    """Dimension buckets; an age outside (0, 100] has none."""
    return bucket(age, [(18, "0-18"), (35, "19-35"), (50, "36-50"), (100, "51+")], 0)


def age_bucket_customer(age: Column) -> Column:
    """Feature buckets, closed on the left."""
    return (
        F.when(age.isNull(), "Unknown")
        .when(age < 25, "<25")
        .when(age < 35, "25-34")
        .when(age < 50, "35-49")
        .otherwise("50+")
    )


def age_group(age: Column) -> Column:
    return bucket(age, [(25, "<25"), (40, "25-40"), (60, "40-60"), (100, "60+")], 0,
                  include_lowest=True)


def tenure_bucket(days: Column) -> Column:
    return bucket(days, [(180, "<6m"), (365, "6-12m"), (730, "1-2y"), (10_000, "2y+")], -1)
