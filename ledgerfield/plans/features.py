"""Features for profiles, credit analysis and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerfield import constants as K
from ledgerfield.functions import money
from ledgerfield.functions.buckets import age_group, tenure_bucket
from ledgerfield.functions.numbers import clip, flag, log1p_floored
from ledgerfield.operators.frames import with_defaults
from ledgerfield.operators.joins import attach_group_values
from ledgerfield.operators.quantiles import medians, percent_rank_average


def add_customer_features(df: DataFrame) -> DataFrame:
    new = {}
    if "age" in df.columns:
        new["customer_age_group"] = age_group(F.col("age"))
    if "account_age_days" in df.columns:
        new["tenure_bucket"] = tenure_bucket(F.col("account_age_days"))
    return df.withColumns(new)


def add_risk_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "outstanding_to_financed": money.outstanding_to_financed(
            F.col("outstanding_balance"), F.col("financed_amount")),
        "arrears_rate": money.arrears_rate(F.col("arrears_balance"), F.col("outstanding_balance")),
        "days_past_due_cap": clip(F.col("days_past_due"), 0, 90),
    })
    df = df.withColumn("risk_stress_score", money.risk_stress_score(
        F.col("is_in_arrears"), F.col("is_default"), F.col("days_past_due_cap")))
    if "annual_income" in df.columns and "total_debt" in df.columns:
        df = df.withColumn("debt_to_income", money.debt_to_income(
            F.col("total_debt"), F.col("annual_income")))
    return df


def add_behavioral_features(df: DataFrame) -> DataFrame:
    """Acquisition and recency features. Whole-column figures come as one-row subqueries."""
    df = _fill_days(df)
    df = _lead_quality(df)
    if "account_age_days" not in df.columns:
        return df
    oldest = df.select(F.greatest(F.max("account_age_days"), F.lit(1))).scalar()
    accounts = F.col("account_count") if "account_count" in df.columns else F.lit(1)
    df = df.withColumns({
        "recency_score": 1.0 - F.col("account_age_days") / oldest,
        "frequency_score": clip(accounts, high=3) / 3.0,
    })
    return percent_rank_average(df, "financed_amount", "monetary_score")


def _fill_days(df: DataFrame) -> DataFrame:
    """Missing day counts get the column median; the delay flag is taken after the fill."""
    present = [c for c in ("days_to_sale", "installation_delay_days") if c in df.columns]
    if present:
        middle = medians(df, present)
        filled = {c: F.coalesce(F.col(c).cast("double"), middle.getField(c)) for c in present}
    else:
        filled = {}
    new = {"lead_conversion_speed": filled.get("days_to_sale", F.lit(None).cast("double"))}
    if "installation_delay_days" in filled:
        new["installation_delay_days"] = filled["installation_delay_days"]
    df = df.withColumns(new)
    late = flag(F.col("installation_delay_days") < 0) \
        if "installation_delay_days" in df.columns else F.lit(0)
    return df.withColumn("install_delay_flag", late)


def _lead_quality(df: DataFrame) -> DataFrame:
    """Share of healthy customers per lead source; 0.5 without a source."""
    if "lead_source" not in df.columns:
        return df.withColumn("lead_quality_score", F.lit(0.5))
    healthy = df.where("lead_source IS NOT NULL").groupBy("lead_source") \
        .agg(F.avg("is_healthy").alias("__healthy"))
    joined = attach_group_values(df, healthy, "lead_source")
    return joined.withColumn("lead_quality_score", F.coalesce("__healthy", F.lit(0.5))) \
        .drop("__healthy")


def segmentation_features(df: DataFrame) -> DataFrame:
    """Columns used for clustering; missing ones get defaults, missing categories "Unknown"."""
    df = df.withColumns({
        "financed_amount_log": log1p_floored(F.col("financed_amount")),
        "product_tier_ord": money.tier_ordinal(F.col("product_tier")),
        "payment_type_enc": money.is_payg(F.col("payment_type")),
    })
    df = with_defaults(df, {
        **{c: F.lit(0) for c in K.BINARY_FEATURES},
        **{c: F.lit(0.0) for c in K.NUMERIC_FEATURES},
        **{c: F.lit("Unknown") for c in K.CATEGORICAL_FEATURES},
    })
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in K.CATEGORICAL_FEATURES})


def feature_columns() -> list[str]:
    return K.NUMERIC_FEATURES + K.CATEGORICAL_FEATURES + K.BINARY_FEATURES


__all__ = ["add_behavioral_features", "add_customer_features", "add_risk_features",
           "feature_columns", "segmentation_features"]
