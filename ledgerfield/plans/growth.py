"""Sales growth over the written marts and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerfield.functions.dates import month_start, quarter_label, quarter_start
from ledgerfield.operators.aggregates import count_by, pivot_values
from ledgerfield.operators.joins import left_lookup
from ledgerfield.operators.ordering import percent_change, percent_change_down, rolling_mean


def with_country_names(df: DataFrame, dim_country: DataFrame) -> DataFrame:
    names = dim_country.select(F.col("country_id").alias("country_key"), "country_name")
    return left_lookup(df, names, [("country_id", "country_key")])


def _sales_by_period(fact_sales: DataFrame, dim_country: DataFrame, period, name: str) -> DataFrame:
    """Counts per country and period; names are joined to the counts, not to the facts."""
    dated = fact_sales.select("country_id", period(F.col("sale_date")).alias(name)) \
        .na.drop(subset=[name])
    return with_country_names(count_by(dated, ["country_id", name], "sales_count"), dim_country)


def quarterly_growth_table(fact_sales: DataFrame, dim_country: DataFrame,
                           countries: list[str]) -> DataFrame:
    """Quarter x country sales, 0 where there are none, with growth against the row before."""
    counts = _sales_by_period(fact_sales, dim_country, quarter_start, "quarter")
    table = pivot_values(counts, "quarter", "country_name", countries, F.sum("sales_count"), 0)
    return percent_change_down(table, "quarter", countries)


def quarterly_growth(mart_sales: DataFrame) -> DataFrame:
    """Growth per country against its previous quarter with sales."""
    date = F.col("sale_date")
    periods = mart_sales.select(
        "country_name", F.year(date).alias("yr"), F.quarter(date).alias("qtr"),
        quarter_label(date).alias("period")).na.drop()
    counts = count_by(periods, ["country_name", "yr", "qtr", "period"], "sales")
    return percent_change(counts, "country_name", ["yr", "qtr"], "sales", "qoq_pct")


def quarterly_growth_heat_table(mart_sales: DataFrame, periods: list[str]) -> DataFrame:
    """Country x quarter growth; null without a value."""
    return pivot_values(quarterly_growth(mart_sales), "country_name", "period", periods,
                        F.max("qoq_pct"))


def monthly_sales(mart_sales: DataFrame) -> DataFrame:
    """Monthly sales per country with the mean of the last three months that have sales."""
    months = mart_sales.select("country_name", month_start(F.col("sale_date")).alias("month")) \
        .na.drop()
    counts = count_by(months, ["country_name", "month"], "sales")
    return rolling_mean(counts, "country_name", "month", "sales", 3, "rolling_mean")


def monthly_sales_table(fact_sales: DataFrame, dim_country: DataFrame,
                        countries: list[str]) -> DataFrame:
    counts = _sales_by_period(fact_sales, dim_country, month_start, "month")
    return pivot_values(counts, "month", "country_name", countries, F.sum("sales_count"), 0)


def lead_source_mix(mart_sales: DataFrame) -> DataFrame:
    counts = count_by(mart_sales, ["country_name", "lead_source_name"], "sales_count")
    return counts.orderBy("country_name", F.col("sales_count").desc(), "lead_source_name")


def date_ranges(fact_sales: DataFrame, fact_installations: DataFrame,
                fact_lead_funnel: DataFrame) -> DataFrame:
    """(table, column, first, last)."""
    ranges = [
        ("fact_sales", fact_sales, ["sale_date"]),
        ("fact_installations", fact_installations, ["sale_date", "installation_date"]),
        ("fact_lead_funnel", fact_lead_funnel, ["lead_created_date"]),
    ]
    out = None
    for table, df, columns in ranges:
        one = df.agg(*[F.struct(F.min(c).alias("first"), F.max(c).alias("last")).alias(c)
                       for c in columns])
        rows = one.select(F.inline(F.array(*[
            F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"),
                     F.col(f"{c}.first").alias("first"), F.col(f"{c}.last").alias("last"))
            for c in columns])))
        out = rows if out is None else out.unionByName(rows)
    return out
