"""Order-dependent operators over periods, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def percent_change(df: DataFrame, group: str, order: list[str], value: str,
                   name: str) -> DataFrame:
    """Change against the group's previous row in percent; the first row of a group is dropped.

    Meant for counts per period: a group has as many rows as there are periods.
    """
    previous = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    changed = df.withColumn("__previous", previous).where("__previous IS NOT NULL")
    return changed.withColumn(
        name, F.try_divide(F.col(value) - F.col("__previous"), F.col("__previous")) * 100.0
    ).drop("__previous")


def percent_change_down(table: DataFrame, order: str, columns: list[str],
                        suffix: str = "_growth_pct") -> DataFrame:
    """The same down every column of a pivot table, whose rows are periods; a base of 0 gives null."""
    window = Window.orderBy(order)
    return table.withColumns({
        f"{c}{suffix}": F.try_divide(F.col(c) - F.lag(c).over(window), F.lag(c).over(window)) * 100.0
        for c in columns})


def rolling_mean(df: DataFrame, group: str, order: str, value: str, rows: int,
                 name: str) -> DataFrame:
    """Mean over the last rows of the group, fewer at its start."""
    window = Window.partitionBy(group).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.avg(value).over(window))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                  rank: str = "rank") -> DataFrame:
    """First n rows per group. Spark limits each group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def sample_rows(df: DataFrame, order: list[str], n: int, most: int = 50) -> DataFrame:
    """First rows by key, with n held between 1 and most (the report's own row limit)."""
    return df.orderBy(*order).limit(min(max(n, 1), most))


def preview(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_two_with_filler(df: DataFrame, eligible: Column, score: str, key: str) -> DataFrame:
    """Best two rows, eligible ones first."""
    return df.orderBy(F.when(eligible, 0).otherwise(1), F.col(score).desc(), F.col(key)).limit(2)


def days_since_first(df: DataFrame, key: str, moment: str, name: str) -> DataFrame:
    """Elapsed days since the key's earliest moment."""
    from ledgerfield.functions.dates import elapsed_days
    from ledgerfield.operators.joins import left_lookup

    first = df.groupBy(key).agg(F.min(moment).alias("__first"))
    joined = left_lookup(df, first, [(key, key)])
    return joined.withColumn(name, elapsed_days(F.col(moment), F.col("__first"))).drop("__first")
