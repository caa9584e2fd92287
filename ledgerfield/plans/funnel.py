"""Lead funnel queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerfield.functions.keys import without_sentinel
from ledgerfield.functions.numbers import round_even
from ledgerfield.operators.aggregates import rows_from_one
from ledgerfield.operators.quality import at_most, run_checks
from ledgerfield.plans.growth import with_country_names

STEP_DAYS = ["days_to_account", "days_to_sale", "days_to_dispatch"]


def _leads_with_country(fact_lead_funnel: DataFrame, dim_customer: DataFrame) -> DataFrame:
    customers = dim_customer.select("customer_id", "country_id")
    return fact_lead_funnel.join(customers, "customer_id")


def conversion_by_country(fact_lead_funnel: DataFrame, dim_customer: DataFrame,
                          dim_country: DataFrame) -> DataFrame:
    """Leads without a known customer drop out."""
    totals = _leads_with_country(fact_lead_funnel, dim_customer).groupBy("country_id").agg(
        F.count("lead_id").alias("total_leads"),
        F.sum("converted_to_sale").alias("sales_from_leads"),
        F.avg("lead_quality_score").alias("avg_quality"),
        F.avg("days_to_sale").alias("avg_days_to_sale"))
    rated = totals.withColumn(
        "conversion_rate", F.col("sales_from_leads") * 100.0 / F.col("total_leads"))
    return with_country_names(rated, dim_country).drop("country_id")


def _mean_if_positive(column: str) -> Column:
    return round_even(F.avg(F.when(F.col(column) > 0, F.col(column))), 1)


def _step_rate(part: str, whole: str) -> Column:
    rate = round_even(F.try_divide(F.col(part) * 100.0, F.col(whole)), 1)
    return F.coalesce(rate, F.lit(0.0))


def funnel_by_source(fact_lead_funnel: DataFrame, dim_lead_source: DataFrame) -> DataFrame:
    """Stages per lead source. A stage never counts more than the one before it.

    The account stage counts leads with a customer, not the conversion flag.
    """
    has_customer = F.col("customer_id") != ""
    stages = fact_lead_funnel.groupBy("lead_source_id").agg(
        F.count_distinct("lead_id").alias("total_leads"),
        F.count_if(has_customer).alias("raw_account"),
        F.count_if((F.col("converted_to_sale") == 1) & has_customer).alias("raw_sale"),
        F.count_if((F.col("converted_to_installation") == 1) & has_customer)
        .alias("raw_installation"),
        *[_mean_if_positive(c).alias(f"avg_{c}") for c in STEP_DAYS])
    named = stages.join(dim_lead_source, "lead_source_id")
    capped = named.withColumn("to_account", F.least("raw_account", "total_leads"))
    capped = capped.withColumn("to_sale", F.least("raw_sale", "to_account"))
    capped = capped.withColumn("to_installation", F.least("raw_installation", "to_sale"))
    return capped.select(
        F.col("lead_source_name").alias("lead_source"), "total_leads", "to_account", "to_sale",
        "to_installation", *[f"avg_{c}" for c in STEP_DAYS],
        _step_rate("to_account", "total_leads").alias("cr_lead_to_account"),
        _step_rate("to_sale", "to_account").alias("cr_account_to_sale"),
        _step_rate("to_installation", "to_sale").alias("cr_sale_to_installation"))


def overall_funnel(by_source: DataFrame) -> DataFrame:
    """Four stages with their share of the first and the loss against the one before."""
    stages = [("Total Leads", "total_leads"), ("Converted to Account", "to_account"),
              ("Converted to Sale", "to_sale"), ("Installed", "to_installation")]
    one = by_source.agg(*[F.sum(c).alias(c) for _, c in stages])
    rows = []
    for i, (label, c) in enumerate(stages):
        lost = F.abs(F.col(c) - F.col(stages[i - 1][1])) if i else F.lit(0).cast("bigint")
        rows.append([
            ("stage_order", F.lit(i + 1)), ("stage", F.lit(label)), ("count", F.col(c)),
            ("pct_of_top", round_even(F.try_divide(F.col(c) * 100.0, F.col("total_leads")), 1)),
            ("drop_off", lost)])
    return rows_from_one(one, rows)


def conversion_rate_checks(by_source: DataFrame) -> DataFrame:
    return run_checks(by_source, [at_most(c, 100) for c in (
        "cr_lead_to_account", "cr_account_to_sale", "cr_sale_to_installation")])


def funnel_summary(fact_lead_funnel: DataFrame) -> DataFrame:
    return fact_lead_funnel.agg(
        F.count("*").alias("total_rows"),
        F.sum("converted_to_account").alias("sum_conv_acc"),
        F.sum("converted_to_sale").alias("sum_conv_sale"),
        F.sum("converted_to_installation").alias("sum_conv_inst"),
        F.avg("lead_quality_score").alias("avg_quality"),
        F.count_if(F.col("lead_quality_score") > 0).alias("positive_quality_count"))


def conversion_times(fact_lead_funnel: DataFrame) -> DataFrame:
    """Mean days of leads that became a sale."""
    return fact_lead_funnel.where("converted_to_sale = 1").agg(
        F.avg("days_to_account").alias("avg_days_acc"),
        F.avg("days_to_sale").alias("avg_days_sale"),
        F.avg("days_to_dispatch").alias("avg_days_disp"))


def step_days_by_country(fact_lead_funnel: DataFrame, dim_customer: DataFrame,
                         dim_country: DataFrame, sentinel: int = 99999) -> DataFrame:
    """Per country and step: sentinel and valid counts, mean and median of the valid days.

    All three steps are aggregated in one pass and turned into rows afterwards.
    """
    leads = _leads_with_country(fact_lead_funnel, dim_customer)
    wide = leads.groupBy("country_id").agg(*[
        F.struct(
            F.count("*").alias("total_records"),
            F.count_if(F.col(c) == sentinel).alias("sentinel_count"),
            F.count_if(F.col(c) != sentinel).alias("valid_count"),
            F.avg(without_sentinel(F.col(c), sentinel)).alias("avg_valid_days"),
            F.median(without_sentinel(F.col(c), sentinel)).alias("median_valid_days"),
        ).alias(c) for c in STEP_DAYS])
    rows = wide.select("country_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), *[F.col(f"{c}.{n}").alias(n) for n in (
            "total_records", "sentinel_count", "valid_count", "avg_valid_days",
            "median_valid_days")]) for c in STEP_DAYS])))
    return with_country_names(rows, dim_country).drop("country_id")


def sentinel_shares(fact_lead_funnel: DataFrame, sentinel: int = 99999) -> DataFrame:
    """(metric, total, sentinels, share_pct) over the whole funnel."""
    one = fact_lead_funnel.agg(F.count("*").alias("total"), *[
        F.count_if(F.col(c) == sentinel).alias(c) for c in STEP_DAYS])
    return rows_from_one(one, [
        [("metric", F.lit(c)), ("total", F.col("total")), ("sentinels", F.col(c)),
         ("share_pct", F.col(c) * 100.0 / F.col("total"))] for c in STEP_DAYS])


def lead_quality_range(fact_lead_funnel: DataFrame) -> DataFrame:
    return fact_lead_funnel.agg(
        F.min("lead_quality_score").alias("min_quality"),
        F.max("lead_quality_score").alias("max_quality"),
        F.avg("lead_quality_score").alias("avg_quality"),
        F.count("*").alias("leads"))
