"""Fact tables from the raw sheets.

Every join is an equi-join that keeps all matches; rows that a fact leaves out are left out by inner joins.
Rows without a key (a lead without customer, an account without installation) are dealt over many tasks by
``spread_nulls_by``. What an account brings along is gathered before the rows it belongs to are joined, texts
are parsed and keys numbered on the way, so that a shuffle carries few columns and every column few times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerfield import constants as K
from ledgerfield.functions.dates import elapsed_days, parse_date, parse_timestamp
from ledgerfield.functions.keys import (
    country_number,
    lead_source_number,
    strip_prefix_number,
    surrogate_key,
    text_or_empty,
)
from ledgerfield.functions.money import lead_quality, lead_quality_with_speed
from ledgerfield.functions.numbers import flag, present
from ledgerfield.operators.frames import clean_headers, keep_valid_uuid
from ledgerfield.operators.joins import left_lookup, one_per_key
from ledgerfield.operators.ordering import days_since_first
from ledgerfield.plans.dimensions import country_key


def _regions(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("id").alias("customer_key"), "region")


def _matched(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows of the left with all their matches; a row without one, or without a key, goes."""
    right = right.withColumnRenamed(right_key, "__key")
    return left.join(right, left[key] == right["__key"]).drop("__key")


def fact_sales(sales: DataFrame, accounts: DataFrame, leads: DataFrame,
               customers: DataFrame) -> DataFrame:
    """Sales whose customer has a country and whose lead has a source."""
    account = accounts.select(
        F.col("id").alias("account_key"),
        "customer_id",
        F.col("status").alias("account_status"),
        F.col("type").alias("account_type"),
        F.col("Agent_id").alias("agent_id"),
        F.col("Proudct_id").alias("product_id"),
        "lead_id",
    )
    lead = leads.select(F.col("Id").alias("lead_key"), "Source").where("Source IS NOT NULL")
    region = _regions(customers).where("region IS NOT NULL")
    created = parse_timestamp(F.col("created_at"))
    sale = sales.select(F.col("Id").alias("sale_id"), "account_id",
                        parse_date(F.col("Sale_date")).alias("sale_date"), created.alias("created_at"))
    account = _matched(account, lead, "lead_id", "lead_key").drop("lead_id")
    account = _matched(account, region, "customer_id", "customer_key")
    return _matched(sale, account, "account_id", "account_key").select(
        F.col("sale_id").cast("string").alias("sale_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_id").cast("string").alias("product_id"),
        surrogate_key(F.col("Source")).alias("lead_source_id"),
        F.col("agent_id").cast("string").alias("agent_id"),
        F.col("account_id").cast("string").alias("account_id"),
        country_key(F.col("region")).alias("country_id"),
        "sale_date",
        F.col("created_at").alias("sale_timestamp"),
        text_or_empty(F.col("account_type")).alias("account_type"),
        text_or_empty(F.col("account_status")).alias("account_status"),
        "created_at",
    )


def _source_of_sold_leads(sales: DataFrame, accounts: DataFrame, leads: DataFrame) -> DataFrame:
    """(lead_id, source) of leads with a sale. Every sale of a lead tells the same, the source of the lead;
    of a repeated lead the smallest one counts."""
    sold = _matched(
        sales.select("account_id"),
        accounts.select(F.col("id").alias("account_key"), "lead_id").where("lead_id IS NOT NULL"),
        "account_id", "account_key").select("lead_id")
    sourced = left_lookup(
        sold, leads.select(F.col("Id").alias("lead_key"), "Source"), [("lead_id", "lead_key")])
    return one_per_key(sourced, "lead_id", []).select(F.col("lead_id").alias("sold_lead_id"), "Source")


def fact_accounts_snapshots(accounts: DataFrame, sales: DataFrame, leads: DataFrame,
                            customers: DataFrame) -> DataFrame:
    """Accounts with a country and a status.

    The age counts from the first row of the same account id, so it is 0 while ids are unique.
    """
    account = accounts.select(
        F.col("id").alias("account_id"),
        "customer_id",
        F.col("Proudct_id").alias("product_id"),
        "status",
        F.col("type").alias("payment_type"),
        parse_timestamp(F.col("created_at")).alias("created_at"),
        parse_date(F.col("First_installment_date")).alias("activation_date"),
        "lead_id",
    )
    # The age comes first: lookups repeat or keep rows, so the first row of an id stays as it is, and the
    # shuffle for it does not carry what they add.
    aged = days_since_first(account, "account_id", "created_at", "account_age_days")
    known = left_lookup(aged.where("status IS NOT NULL"), _source_of_sold_leads(sales, accounts, leads),
                        [("lead_id", "sold_lead_id")], "account_id").drop("lead_id")
    region = _regions(customers).where("region IS NOT NULL")
    return _matched(known, region, "customer_id", "customer_key").select(
        F.col("account_id").cast("string").alias("account_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_id").cast("string").alias("product_id"),
        country_key(F.col("region")).alias("country_id"),
        text_or_empty(surrogate_key(F.col("Source"))).alias("lead_source_id"),
        surrogate_key(F.col("status")).alias("account_status_id"),
        "activation_date",
        "account_age_days",
        "payment_type",
        F.col("status").isin(K.SNAPSHOT_ARREARS_STATUSES).alias("is_currently_in_arrears"),
        "created_at",
    )


def fact_installations(installations: DataFrame, accounts: DataFrame, sales: DataFrame,
                       dim_customer: DataFrame) -> DataFrame:
    """Installations whose account belongs to a known customer; a repeated id keeps all matches."""
    installation = installations.select(
        F.col("Id").alias("installation_id"), "engineer_id",
        parse_date(F.col("Installation_date")).alias("installation_date"),
        parse_timestamp(F.col("created_at")).alias("created_at"))
    account = accounts.where("Installation_id IS NOT NULL").select(
        F.col("Installation_id").alias("installation_key"),
        F.col("id").alias("account_id"),
        "customer_id",
        F.col("status").alias("installation_status"),
        F.col("Proudct_id").alias("product_id"),
    )
    customer = dim_customer.select(
        F.col("customer_id").alias("customer_key"), "country_id", "location_id").where("country_id IS NOT NULL")
    sale = sales.select(F.col("account_id").alias("account_key"),
                        parse_date(F.col("Sale_date")).alias("sale_date"))
    account = left_lookup(account, sale, [("account_id", "account_key")], "installation_key")
    account = _matched(account, customer, "customer_id", "customer_key")
    return _matched(installation, account, "installation_id", "installation_key").select(
        F.col("installation_id").cast("string").alias("installation_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("account_id").cast("string").alias("account_id"),
        F.col("product_id").cast("string").alias("product_id"),
        F.col("engineer_id").cast("string").alias("engineer_id"),
        "country_id",
        F.coalesce("location_id", "country_id").alias("location_id"),
        "sale_date",
        "installation_date",
        "installation_status",
        "created_at",
    )


def fact_lead_funnel(leads: DataFrame, accounts: DataFrame, sales: DataFrame) -> DataFrame:
    """Lead funnel with days to dispatch; negative days become null."""
    lead = leads.select(
        F.col("Id").alias("lead_id"),
        "customer_id",
        surrogate_key(F.col("Source")).alias("lead_source_id"),
        parse_timestamp(F.col("created_at")).alias("lead_created"),
    )
    account = accounts.where("lead_id IS NOT NULL").select(
        F.col("lead_id").alias("lead_key"),
        F.col("id").alias("account_id"),
        present(F.col("Installation_id")).alias("installed"),
        parse_timestamp(F.col("created_at")).alias("account_created"),
        parse_timestamp(F.col("Dispatch_date")).alias("dispatched"),
        F.col("Agent_id").alias("agent_id"),
        F.lit(1).alias("has_account"),
    )
    sale = sales.select(
        F.col("account_id").alias("account_key"),
        present(F.col("Id")).alias("has_sale"),
        parse_timestamp(F.col("Sale_date")).alias("sold"),
    )
    sold = left_lookup(account, sale, [("account_id", "account_key")]).drop("account_id")
    joined = keep_valid_uuid(left_lookup(lead, sold, [("lead_id", "lead_key")]), "lead_source_id")
    to_account = present(F.col("has_account"))
    to_sale = F.coalesce("has_sale", F.lit(0))
    to_installation = F.coalesce("installed", F.lit(0))
    start = F.col("lead_created")
    return joined.select(
        F.col("lead_id").cast("string").alias("lead_id"),
        text_or_empty(F.col("customer_id")).alias("customer_id"),
        "lead_source_id",
        F.col("agent_id").cast("string").alias("agent_id"),
        start.cast("date").alias("lead_created_date"),
        to_account.alias("converted_to_account"),
        to_sale.alias("converted_to_sale"),
        to_installation.alias("converted_to_installation"),
        elapsed_days(F.col("account_created"), start, "null_negative").alias("days_to_account"),
        elapsed_days(F.col("sold"), start, "null_negative").alias("days_to_sale"),
        elapsed_days(F.col("dispatched"), start, "null_negative").alias("days_to_dispatch"),
        lead_quality(to_account, to_sale, to_installation).alias("lead_quality_score"),
    )


def fact_lead_funnel_numeric(leads: DataFrame, accounts: DataFrame, sales: DataFrame,
                             installations: DataFrame, customers: DataFrame) -> DataFrame:
    """Lead funnel with numeric keys, days to installation and a speed bonus in the score;
    negative days become 0."""
    leads, accounts, sales, installations, customers = (
        clean_headers(df, spaces_to_underscore=False)
        for df in (leads, accounts, sales, installations, customers))
    lead = leads.select(
        F.col("id").alias("lead_text"), "customer_id",
        lead_source_number(F.col("source")).alias("lead_source_id"),
        parse_timestamp(F.col("created_at")).alias("lead_created"))
    account = accounts.where("lead_id IS NOT NULL").select(
        F.col("lead_id").alias("lead_key"),
        F.col("id").alias("account_id"),
        F.col("agent_id").alias("employee_id"),
        "installation_id",
        parse_timestamp(F.col("created_at")).alias("account_created"))
    sale = sales.select(
        F.col("account_id").alias("account_key"),
        parse_timestamp(F.col("sale_date")).alias("sold"))
    installation = installations.select(
        F.col("id").alias("installation_key"),
        parse_timestamp(F.col("installation_date")).alias("installed"))
    customer = customers.select(F.col("id").alias("customer_key"),
                                country_number(F.col("region")).alias("country_id"))
    account = left_lookup(account, sale, [("account_id", "account_key")], "lead_key") \
        .withColumn("has_account", present(F.col("account_id"))).drop("account_id")
    account = left_lookup(account, installation, [("installation_id", "installation_key")],
                          "lead_key").drop("installation_id")
    lead = left_lookup(lead, customer, [("customer_id", "customer_key")], "lead_text")
    joined = left_lookup(lead, account, [("lead_text", "lead_key")])
    to_account = F.coalesce("has_account", F.lit(0))
    to_sale = present(F.col("sold"))
    to_installation = present(F.col("installed"))
    start = F.col("lead_created")
    days_to_account = elapsed_days(F.col("account_created"), start, "clamp")
    return joined.select(
        strip_prefix_number(F.col("lead_text"), "LEAD-").alias("lead_id"),
        text_or_empty(F.col("customer_id")).alias("customer_id"),
        "lead_source_id",
        text_or_empty(F.col("employee_id")).alias("employee_id"),
        F.coalesce("country_id", country_number(F.lit(None).cast("string"))).alias("country_id"),
        start.cast("date").alias("lead_created_date"),
        to_account.alias("converted_to_account"),
        to_sale.alias("converted_to_sale"),
        to_installation.alias("converted_to_installation"),
        days_to_account.alias("days_to_account"),
        elapsed_days(F.col("sold"), start, "clamp").alias("days_to_sale"),
        elapsed_days(F.col("installed"), start, "clamp").alias("days_to_installation"),
        lead_quality_with_speed(to_account, to_sale, to_installation, days_to_account)
        .alias("lead_quality_score"),
        F.current_timestamp().alias("created_at"),
    )


def funnel_quality_summary(funnel: DataFrame) -> DataFrame:
    """One row of totals over the numeric lead funnel."""
    return funnel.agg(
        F.count("*").alias("total_rows"),
        F.sum("converted_to_account").alias("to_account"),
        F.avg("converted_to_account").alias("to_account_share"),
        F.sum("converted_to_sale").alias("to_sale"),
        F.avg("converted_to_sale").alias("to_sale_share"),
        F.sum("converted_to_installation").alias("to_installation"),
        F.avg("converted_to_installation").alias("to_installation_share"),
        F.sum(flag(F.col("lead_source_id") == 0)).alias("unknown_lead_source"),
        F.sum(flag(F.col("country_id") == 0)).alias("unknown_country"),
        F.sum(flag(F.col("employee_id") == "")).alias("missing_employee"),
        F.sum(flag(F.col("days_to_account") == 0)).alias("zero_days_to_account"),
        F.avg("lead_quality_score").alias("avg_lead_quality_score"),
    )
