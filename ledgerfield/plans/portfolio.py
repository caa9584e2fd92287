"""Portfolio KPIs and credit risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerfield.functions.numbers import rate_pct, round_even
from ledgerfield.operators.aggregates import count_by, pivot_values, rates_by
from ledgerfield.operators.frames import (
    equals_flag,
    equals_ignoring_case,
    keep_existing,
    matches_pattern,
)
from ledgerfield.operators.joins import left_lookup
from ledgerfield.operators.ordering import sample_rows
from ledgerfield.plans.growth import with_country_names

CUSTOMER_COLUMNS = ["customer_id", "country_name", "payment_type", "product_tier",
                    "account_status", "is_in_arrears", "is_default", "repayment_progress",
                    "financed_amount", "segment_name"]


def portfolio_kpis(customers: DataFrame, country: str | None = None) -> dict[str, DataFrame]:
    """``overall`` (one row), ``by_country`` and ``by_payment_type``; no overall row without data."""
    rows = equals_ignoring_case(customers, "country_name", country)
    overall = rows.agg(
        F.count("*").alias("customers"),
        rate_pct(F.col("is_in_arrears")).alias("arrears_rate_pct"),
        rate_pct(F.col("is_default")).alias("default_rate_pct"),
        round_even(F.avg("repayment_progress"), 3).alias("avg_repayment_progress"),
        round_even(F.avg("financed_amount"), 0).alias("avg_financed_proxy"),
    ).where("customers > 0")
    return {
        "overall": overall,
        "by_country": rates_by(rows, ["country_name"], arrears_pct="is_in_arrears"),
        "by_payment_type": rates_by(rows, ["payment_type"], arrears_pct="is_in_arrears"),
    }


def portfolio_kpi_table(customers: DataFrame, country: str | None = None) -> DataFrame:
    """The same three results in one pass: (level, label, customers, arrears_pct, ...)."""
    rows = equals_ignoring_case(customers, "country_name", country)
    sets = rows.groupingSets([[], [F.col("country_name")], [F.col("payment_type")]],
                             "country_name", "payment_type").agg(
        F.grouping_id("country_name", "payment_type").alias("gid"),
        F.count("*").alias("customers"),
        rate_pct(F.col("is_in_arrears")).alias("arrears_pct"),
        rate_pct(F.col("is_default")).alias("default_pct"),
        round_even(F.avg("repayment_progress"), 3).alias("avg_repayment_progress"),
        round_even(F.avg("financed_amount"), 0).alias("avg_financed_proxy"))
    level = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "country") \
        .otherwise("payment_type")
    label = F.coalesce("country_name", "payment_type")
    # A missing country or payment type is no group of its own.
    known = sets.where((F.col("gid") == 3) | label.isNotNull())
    return known.select(level.alias("level"), F.coalesce(label, F.lit("all")).alias("label"),
                        "customers", "arrears_pct", "default_pct", "avg_repayment_progress",
                        "avg_financed_proxy")


def matching_customers(customers: DataFrame, country: str | None = None,
                       payment_type: str | None = None, in_arrears: bool | None = None,
                       is_default: bool | None = None,
                       segment_name: str | None = None) -> DataFrame:
    rows = equals_ignoring_case(customers, "country_name", country)
    rows = equals_ignoring_case(rows, "payment_type", payment_type)
    rows = equals_flag(rows, "is_in_arrears", in_arrears)
    rows = equals_flag(rows, "is_default", is_default)
    return matches_pattern(rows, "segment_name", segment_name)


def customer_query(customers: DataFrame, limit: int = 20, **filters) -> dict[str, DataFrame]:
    """``summary`` (matched count and rates, 0 without a match) and ``sample`` (1 to 50 rows)."""
    rows = matching_customers(customers, **filters)
    zero = lambda c: F.coalesce(rate_pct(F.col(c)), F.lit(0.0))
    summary = rows.agg(
        F.count("*").alias("matched"),
        zero("is_in_arrears").alias("arrears_rate_pct"),
        zero("is_default").alias("default_rate_pct"))
    sample = sample_rows(keep_existing(rows, CUSTOMER_COLUMNS), ["customer_id"], limit)
    return {"summary": summary, "sample": sample}


def segment_list(customers: DataFrame) -> DataFrame:
    """Size and risk per segment; customers without a segment form a row of their own."""
    return customers.groupBy("segment_id", "segment_name").agg(
        F.count("customer_id").alias("customers"),
        rate_pct(F.col("is_in_arrears")).alias("arrears_pct"),
        rate_pct(F.col("is_default")).alias("default_pct"),
        F.avg("repayment_progress").alias("avg_repayment"),
        F.avg("financed_amount").alias("avg_financed"))


def arrears_by(customers: DataFrame, column: str) -> DataFrame:
    return customers.na.drop(subset=[column]).groupBy(column).agg(
        rate_pct(F.col("is_in_arrears")).alias("is_in_arrears"))


def segments_overview(customers: DataFrame) -> DataFrame:
    rates = rates_by(customers, ["segment_name"], arrears_pct="is_in_arrears")
    return rates.orderBy(F.col("customers").desc(), "segment_name")


def credit_risk_by_country(fact_accounts: DataFrame, dim_country: DataFrame) -> DataFrame:
    totals = fact_accounts.groupBy("country_id").agg(
        F.count("*").alias("total_accounts"),
        F.count_if("is_currently_in_arrears").alias("in_arrears"),
        F.avg("account_age_days").alias("avg_account_age"))
    rated = totals.withColumn("arrears_rate", F.col("in_arrears") * 100.0 / F.col("total_accounts"))
    return with_country_names(rated, dim_country).drop("country_id")


def arrears_flag_table(fact_accounts: DataFrame, dim_country: DataFrame,
                       countries: list[str]) -> DataFrame:
    counts = count_by(fact_accounts, ["country_id", "is_currently_in_arrears"])
    return pivot_values(with_country_names(counts, dim_country), "is_currently_in_arrears",
                        "country_name", countries, F.sum("count"), 0)


def arrears_by_country_and_tier(mart_customers: DataFrame) -> DataFrame:
    return mart_customers.groupBy("country_name", "product_tier").agg(
        F.count_if("is_in_arrears").alias("in_arrears"),
        F.count("*").alias("total"),
        round_even(F.count_if("is_in_arrears") / F.count("*") * 100, 1).alias("arrears_rate_pct"))


def arrears_tier_table(mart_customers: DataFrame, tiers: list[str]) -> DataFrame:
    """Country x tier arrears rate, 0 where a country lacks the tier."""
    return pivot_values(arrears_by_country_and_tier(mart_customers), "country_name",
                        "product_tier", tiers, F.max("arrears_rate_pct"), 0.0)


def product_risk_by_country(fact_accounts: DataFrame, dim_country: DataFrame,
                            dim_product: DataFrame) -> DataFrame:
    totals = fact_accounts.groupBy("country_id", "product_id").agg(
        F.count("*").alias("total"), F.count_if("is_currently_in_arrears").alias("in_arrears"))
    products = dim_product.select(F.col("product_id").alias("product_key"), "product_name")
    named = left_lookup(with_country_names(totals, dim_country), products,
                        [("product_id", "product_key")])
    return named.select(
        F.coalesce("country_name", F.lit("Unknown")).alias("country_name"),
        "product_id", "product_name", "total", "in_arrears",
        (F.col("in_arrears") * 100.0 / F.col("total")).alias("arrears_rate"))


def account_age_details(fact_accounts: DataFrame) -> DataFrame:
    age = "account_age_days"
    return fact_accounts.agg(
        F.min(age).alias("min_age"), F.max(age).alias("max_age"), F.avg(age).alias("avg_age"),
        F.count_if(F.col(age) > 0).alias("non_zero_count"), F.count("*").alias("total"))


def arrears_by_country_and_payment(customers: DataFrame, payment_types: list[str]) -> DataFrame:
    """Country x payment type mean of the arrears flag; null where a pair is missing."""
    return pivot_values(customers.na.drop(subset=["country_name"]), "country_name",
                        "payment_type", payment_types, F.avg("is_in_arrears"))


def rate_by_bin(binned: DataFrame, bin_column: str, flag_column: str) -> DataFrame:
    """Size and rate of a flag per bin."""
    return binned.na.drop(subset=[bin_column]).groupBy(bin_column).agg(
        F.count("*").alias("customers"), _share(flag_column).alias("rate_pct"))


def _share(flag_column: str) -> Column:
    return rate_pct(F.col(flag_column))
