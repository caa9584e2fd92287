"""Group aggregates. All combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ledgerfield.functions.dates import month_start
from ledgerfield.functions.numbers import rate_pct
from ledgerfield.operators.frames import numeric_columns
from ledgerfield.operators.quantiles import medians_by

MOST_COLUMNS = 1_000
BITMAP = 32_768  # values of a bitmap
SPARSE_BYTES = 16  # bytes of bitmap per value beyond which values are cheaper


def count_by(df: DataFrame, keys: list[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def distinct_combinations(df: DataFrame, columns: list[str], name: str = "count") -> DataFrame:
    return count_by(df.select(*columns).na.drop(), columns, name)


def first_present(column: str, order: Column) -> Column:
    """First non-null value by an explicit order (an aggregate)."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def modes_by(df: DataFrame, by: list[str], columns: dict[str, str | None]) -> DataFrame:
    """(by..., columns...): most frequent value as text, the smallest on ties, a default without values.

    Values are counted per group and value first and chosen from the counts, so a task never holds the
    values of a group, however many it has. A null in ``by`` is a group like any other.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    counts = df.select(*by, F.inline(pairs)).groupBy(*by, "metric", "value").agg(
        F.count("value").alias("n"))
    found = F.col("value").isNotNull()
    best = {c: F.min(F.when(found & (F.col("metric") == c), F.struct(-F.col("n"), "value")))["value"]
            for c in columns}
    return counts.groupBy(*by).agg(*[F.coalesce(v, F.lit(columns[c])).alias(c) for c, v in best.items()])


def distinct_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., columns...): exact numbers of distinct values, all in one pass and without an expansion.

    Whole numbers that lie densely are merged as bitmaps of 32,768 values, an eighth of a byte each; other
    columns as text, equal values of a group once. Density is measured (one row is fetched); either way a
    group's values are dealt over tasks.
    """
    whole = [f.name for f in df.schema.fields if f.name in columns and isinstance(
        f.dataType, (ByteType, ShortType, IntegerType, LongType))]
    dense = []
    if whole:
        measured = df.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n")).alias(c)
                            for c in whole]).first()
        dense = [c for c in whole if measured[c]["n"] and
                 ((measured[c]["high"] - measured[c]["low"]) // BITMAP + 1) * BITMAP // 8
                 <= max(BITMAP, SPARSE_BYTES * measured[c]["n"])]
    parts = []
    if dense:
        rows = _melted(df, by, dense, "bigint").withColumns({
            "bucket": F.bitmap_bucket_number("value"), "bit": F.bitmap_bit_position("value")})
        bitmaps = rows.groupBy(*by, "metric", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        parts.append(bitmaps.groupBy(*by, "metric").agg(F.sum(F.bitmap_count("bits")).alias("n")))
    rest = [c for c in columns if c not in dense]
    if rest:
        values = _melted(df, by, rest, "string").distinct()
        parts.append(values.groupBy(*by, "metric").agg(F.count("value").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(*[
        F.max(F.when(F.col("metric") == c, F.col("n"))).alias(c) for c in columns])


def _melted(df: DataFrame, by: list[str], columns: list[str], kind: str) -> DataFrame:
    """(by..., metric, value) rows, nulls too."""
    return df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast(kind).alias("value")) for c in columns])))


def weighted_mean(value: str, weight: str) -> Column:
    """Mean weighted by a column in which 0 counts as 1 (an aggregate)."""
    w = F.when(F.col(weight) == 0, 1.0).otherwise(F.col(weight))
    return F.sum(F.col(value) * w) / F.sum(w)


def share_of(column: str, value) -> Column:
    return F.avg(F.coalesce(F.col(column) == value, F.lit(False)).cast("int"))


def aggregate_spec(df: DataFrame, group_by: list[str], spec: dict[str, str]) -> DataFrame:
    """pandas-style ``{column: function}``; the results keep the column names.

    Medians and distinct counts have plans of their own, so that no group is held in a state; they read
    the frame again, so hand over a written one.
    """
    functions = {
        "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
        "std": F.stddev_samp,
    }
    rows = df.na.drop(subset=group_by)
    plain = [functions[how](F.col(c)).alias(c) for c, how in spec.items() if how in functions]
    result = rows.groupBy(*group_by).agg(*(plain or [F.count("*").alias("__rows")]))
    for how, plan in (("median", lambda columns: medians_by(rows, group_by, columns)),
                      ("nunique", lambda columns: distinct_counts(rows, group_by, columns))):
        columns = [c for c, asked in spec.items() if asked == how]
        if columns:
            result = result.join(plan(columns), group_by, "left")
    return result.select(*group_by, *spec)


def mean_by(df: DataFrame, group_by: list[str]) -> DataFrame:
    """Mean of every numeric column per group."""
    values = [c for c in numeric_columns(df) if c not in group_by]
    return aggregate_spec(df, group_by, {c: "mean" for c in values})


def rates_by(df: DataFrame, keys: list[str], keep_null_keys: bool = False, **flags: str) -> DataFrame:
    """Count and rounded percentage of 0/1 flags per group: ``arrears_pct="is_in_arrears"``."""
    rows = df if keep_null_keys else df.na.drop(subset=keys)
    return rows.groupBy(*keys).agg(
        F.count("customer_id").alias("customers"),
        *[rate_pct(F.col(c)).alias(name) for name, c in flags.items()],
    )


def pivot_values(df: DataFrame, rows: str, columns: str, values: list | None, aggregate: Column,
                 fill=None, others: str | None = None) -> DataFrame:
    """Pivot over the values given, or over those found (None, one job more; a null has no column).

    Rows with a value that is not listed make the query fail rather than vanish, unless ``others`` names
    a column that takes them together.
    """
    if values is None:
        values = sorted(r[0] for r in df.select(columns).na.drop().distinct().limit(MOST_COLUMNS + 1).collect())
        if len(values) > MOST_COLUMNS:
            raise ValueError(f"{columns} has more than {MOST_COLUMNS} values")
    key = F.col(columns)
    unlisted = key.isNotNull() & ~key.isin(values)
    if others is None:
        checked = F.when(unlisted, F.raise_error(F.concat(
            F.lit(f"not among the columns listed for {columns}: "), key.cast("string")))).otherwise(key)
    else:
        checked, values = F.when(unlisted, F.lit(others)).otherwise(key), [*values, others]
    table = df.withColumn(columns, checked).groupBy(rows).pivot(columns, values).agg(aggregate)
    return table if fill is None else table.na.fill(fill)


def cohort_counts(df: DataFrame, cohort_column: str, date_column: str) -> DataFrame:
    months = df.withColumn("cohort_month", month_start(F.col(date_column)))
    return count_by(months.na.drop(subset=["cohort_month", cohort_column]),
                    ["cohort_month", cohort_column])


def business_metrics(df: DataFrame) -> DataFrame:
    """(metric, value) rows: distinct customers and mean order value."""
    mean_order = F.avg("order_value") if "order_value" in df.columns else F.first(F.lit(0.0))
    one = df.agg(F.count_distinct("customer_id").cast("double").alias("c"), mean_order.alias("o"))
    return rows_from_one(one, [
        [("metric", F.lit("total_customers")), ("value", F.col("c"))],
        [("metric", F.lit("average_order_value")), ("value", F.coalesce("o", F.lit(0.0)))]])


def rows_from_one(df: DataFrame, rows: list[list[tuple[str, Column]]]) -> DataFrame:
    """Turn a one-row frame into a few rows of named columns."""
    return df.select(F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in r]) for r in rows])))
