"""Account-level and customer-level analytics tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerfield import constants as K
from ledgerfield.functions import money
from ledgerfield.functions.buckets import age_bucket_customer, age_by_days
from ledgerfield.functions.dates import elapsed_days, parse_timestamp
from ledgerfield.functions.keys import country_display_name, product_tier
from ledgerfield.functions.numbers import flag
from ledgerfield.operators.aggregates import first_present, modes_by, weighted_mean
from ledgerfield.operators.joins import left_lookup, one_per_key
from ledgerfield.operators.quantiles import medians_by, settled
from ledgerfield.plans.features import (
    add_behavioral_features,
    add_customer_features,
    add_risk_features,
)


def account_table(sheets: dict[str, DataFrame]) -> DataFrame:
    """One row per account (and sale, and installation) with customer, product and money proxies."""
    accounts = sheets["Accounts"].select(
        F.col("id").alias("account_id"),
        "customer_id",
        F.col("status").alias("account_status"),
        F.col("type").alias("payment_type"),
        F.col("Installation_id").alias("installation_id"),
        F.col("Proudct_id").alias("product_id"),
        F.col("Agent_id").alias("agent_id"),
        "lead_id",
        parse_timestamp(F.col("created_at")).alias("account_created_at"),
    )
    # The newest account sets the date against which ages are taken.
    reference = accounts.select(F.max("account_created_at")).scalar()
    customers = sheets["Customers"].select(
        F.col("id").alias("customer_key"),
        F.col("Gender").alias("gender"),
        F.col("Location").alias("location"),
        country_display_name(F.col("region")).alias("country_name"),
        parse_timestamp(F.col("Date_of_birth")).alias("date_of_birth"),
    )
    products = sheets["Products"].select(
        F.col("Id").alias("product_key"), F.col("Product").alias("product_name"), "is_refurb")
    sales = sheets["Sales"].select(
        F.col("account_id").alias("account_key"), F.col("Id").alias("sale_id"),
        parse_timestamp(F.col("Sale_date")).alias("sale_date"))
    installations = sheets["Installations"].select(
        F.col("Id").alias("installation_key"),
        parse_timestamp(F.col("Installation_date")).alias("installation_date"), "engineer_id")
    leads = one_per_key(
        sheets["Leads"].select(
            F.col("Id").alias("lead_key"),
            parse_timestamp(F.col("created_at")).alias("lead_created"),
            F.col("customer_id").alias("lead_customer"),
            F.col("Source").alias("source")),
        "lead_key", ["lead_created"])

    # Lookups that add the widest columns come last, so that the earlier shuffles do not carry them.
    df = left_lookup(accounts, sales, [("account_id", "account_key")])
    df = left_lookup(df, leads, [("lead_id", "lead_key")], "account_id")
    # The source counts only when the lead belongs to the same customer; its date counts anyway.
    same_customer = F.col("lead_customer") == F.col("customer_id")
    df = df.withColumns({
        "lead_source": F.when(same_customer, F.col("source")),
        "days_to_sale": elapsed_days(F.col("sale_date"), F.col("lead_created"), "clamp"),
    }).drop("lead_customer", "source", "lead_created")
    df = left_lookup(df, installations, [("installation_id", "installation_key")], "account_id")
    df = left_lookup(df, customers, [("customer_id", "customer_key")], "account_id")
    df = left_lookup(df, products, [("product_id", "product_key")], "account_id")

    df = df.withColumn("__reference", reference)
    df = df.withColumn("age", age_by_days(F.col("date_of_birth"), F.col("__reference")))
    df = df.withColumns({
        "age_bucket": age_bucket_customer(F.col("age")),
        "product_tier": product_tier(F.col("is_refurb")),
        "product_category": F.col("product_name"),
        "account_age_days": elapsed_days(F.col("__reference"), F.col("account_created_at"),
                                         "clamp"),
        "is_in_arrears": flag(F.col("account_status").isin(K.ARREARS_STATUSES)),
        "is_default": flag(F.col("account_status").isin(K.DEFAULT_STATUSES)),
        "is_healthy": flag(F.col("account_status").isin(K.HEALTHY_STATUSES)),
        "installation_delay_days": elapsed_days(F.col("installation_date"), F.col("sale_date")),
    })
    df = df.withColumn("product_tier_ord", money.tier_ordinal(F.col("product_tier")))
    df = df.withColumn(
        "financed_amount",
        money.financed_amount(F.col("product_tier_ord"), F.col("payment_type")))
    df = df.withColumn(
        "outstanding_balance",
        money.outstanding_balance(F.col("financed_amount"), F.col("is_healthy"),
                                  F.col("is_default")))
    df = df.withColumns({
        "arrears_balance": money.arrears_balance(F.col("outstanding_balance"),
                                                 F.col("is_in_arrears")),
        "days_past_due": money.days_past_due(F.col("account_age_days"), F.col("is_in_arrears"),
                                             F.col("is_default")),
        "repayment_progress": money.repayment_progress(F.col("outstanding_balance"),
                                                       F.col("financed_amount")),
    })
    return df.select(
        "account_id", "customer_id", "lead_id", "sale_id", "installation_id", "product_id",
        "agent_id", "engineer_id", "country_name", "gender", "age", "age_bucket", "location",
        "account_status", "payment_type", "lead_source", "product_name", "product_tier",
        "product_category", "account_created_at", "sale_date", "installation_date",
        "account_age_days", "is_in_arrears", "is_default", "is_healthy",
        "installation_delay_days", "days_to_sale", "product_tier_ord", "financed_amount",
        "outstanding_balance", "arrears_balance", "days_past_due", "repayment_progress",
    )


FIRSTS = ["country_name", "gender", "age", "age_bucket", "location", "account_status", "lead_source"]
SUMS = ["financed_amount", "outstanding_balance", "arrears_balance"]
MAXIMA = ["days_past_due", "is_in_arrears", "is_default", "is_healthy", "account_age_days"]
MODES = {"payment_type": "PAYG", "product_tier": K.TIER_NEW, "product_category": ""}
MEDIANS = ["installation_delay_days", "days_to_sale"]
HOT_ACCOUNTS = 1 << 16  # accounts of a customer beyond which no task takes them together


def customer_aggregate(accounts: DataFrame, hot_accounts: int = HOT_ACCOUNTS) -> DataFrame:
    """One row per customer; "first" means first by account id, then sale and installation.

    Accounts are shuffled once by customer, and a task takes a customer's accounts together. Customers with
    more than ``hot_accounts`` are found by a count and taken apart: there all combines before the shuffle,
    so one with a third of all rows is never held in one state. Hand over a written table.
    """
    accounts = accounts.where("customer_id IS NOT NULL")
    counts = accounts.groupBy("customer_id").agg(F.count("*").alias("n"))
    hot = settled(counts.where(F.col("n") > hot_accounts).select(F.col("customer_id").alias("hot_customer")))
    if hot.isEmpty():
        return _gathered(accounts)
    is_hot = accounts["customer_id"] == hot["hot_customer"]
    return _gathered(accounts.join(hot, is_hot, "left_anti")).unionByName(
        _combined(accounts.join(hot, is_hot, "left_semi")))


def _single() -> list[Column]:
    """Aggregates with a state of one row."""
    order = F.struct("account_id", "sale_id", "installation_id")
    return [
        *[first_present(c, order).alias(c) for c in FIRSTS],
        F.count("account_id").alias("account_count"),
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.max(c).alias(c) for c in MAXIMA],
        weighted_mean("repayment_progress", "outstanding_balance").alias("repayment_progress"),
    ]


def _gathered(accounts: DataFrame) -> DataFrame:
    """Customers of bounded size: one shuffle, modes and medians from the values of a customer."""
    return accounts.repartition("customer_id").groupBy("customer_id").agg(
        *_single(),
        *[F.coalesce(F.mode(F.col(c).cast("string"), True), F.lit(v)).alias(c) for c, v in MODES.items()],
        *[F.median(c).alias(c) for c in MEDIANS]).select(*_columns())


def _combined(accounts: DataFrame) -> DataFrame:
    """Customers of any size: modes and medians from counts per customer and value."""
    modes = modes_by(accounts, ["customer_id"], MODES)
    middle = medians_by(accounts, ["customer_id"], MEDIANS)
    each = accounts.groupBy("customer_id").agg(*_single())
    return each.join(modes, "customer_id", "left").join(middle, "customer_id", "left").select(*_columns())


def _columns() -> list[str]:
    return ["customer_id", *FIRSTS, "account_count", *SUMS, *MAXIMA, *MODES, *MEDIANS, "repayment_progress"]


def add_features(customers: DataFrame) -> DataFrame:
    """Demographic, risk and behavioural features of the customer aggregate.

    Whole-column figures read the frame again, so hand over a written one.
    """
    return (
        customers.transform(add_customer_features)
        .transform(add_risk_features)
        .transform(add_behavioral_features)
    )


def customer_table(accounts: DataFrame) -> DataFrame:
    """Customers with all features, straight from the account table."""
    return accounts.transform(customer_aggregate).transform(add_features)


def with_segments(customers: DataFrame, segments: DataFrame | None) -> DataFrame:
    """Attach stored segment labels; columns the customers already have are not repeated."""
    if segments is None:
        return customers
    new = [c for c in segments.columns if c not in customers.columns]
    labels = segments.select(F.col("customer_id").alias("segment_customer"), *new)
    return left_lookup(customers, labels, [("customer_id", "segment_customer")])
