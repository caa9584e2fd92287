"""Analytical marts: star joins over written facts and dimensions.

Dimensions are read from files, so the optimizer knows their size and broadcasts the small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerfield.functions.dates import calendar_days
from ledgerfield.functions.keys import product_tier_of_status, text_or_empty
from ledgerfield.operators.joins import left_lookup


def _country(dim_country: DataFrame) -> DataFrame:
    return dim_country.select(F.col("country_id").alias("country_key"), "country_name")


def _product(dim_product: DataFrame) -> DataFrame:
    return dim_product.select(
        F.col("product_id").alias("product_key"), "product_name", "refurb_status")


def _status(dim_account_status: DataFrame) -> DataFrame:
    return dim_account_status.select(
        F.col("account_status_id").alias("status_key"),
        F.col("account_status_name").alias("account_status"), "risk_category")


def _customer_account_star(fact, dim_customer, dim_country, dim_product, dim_account_status):
    customer = dim_customer.select(
        F.col("customer_id").alias("customer_key"), "gender", "age", "age_bucket")
    # Dimensions that grow come first and small ones last, so that shuffles do not carry their names.
    star = left_lookup(fact, customer, [("customer_id", "customer_key")], "account_id")
    star = left_lookup(star, _product(dim_product), [("product_id", "product_key")], "account_id")
    star = left_lookup(star, _country(dim_country), [("country_id", "country_key")])
    return left_lookup(star, _status(dim_account_status), [("account_status_id", "status_key")])


def mart_customer_account_analytics(fact_accounts_snapshots: DataFrame, dim_customer: DataFrame,
                                    dim_country: DataFrame, dim_product: DataFrame,
                                    dim_account_status: DataFrame) -> DataFrame:
    star = _customer_account_star(fact_accounts_snapshots, dim_customer, dim_country, dim_product,
                                  dim_account_status)
    return star.select(
        "account_id", "customer_id", "country_id", "country_name", "gender", "age", "age_bucket",
        "product_id", "product_name",
        product_tier_of_status(F.col("refurb_status")).alias("product_tier"),
        "account_status_id", "account_status", "risk_category", "payment_type",
        F.col("is_currently_in_arrears").alias("is_in_arrears"),
        "account_age_days", "activation_date", "created_at",
    )


def customer_account_with_placeholders(fact_accounts_snapshots: DataFrame, dim_customer: DataFrame,
                                       dim_country: DataFrame, dim_product: DataFrame,
                                       dim_account_status: DataFrame) -> DataFrame:
    """Variant of the customer mart with constant money columns."""
    star = _customer_account_star(fact_accounts_snapshots, dim_customer, dim_country, dim_product,
                                  dim_account_status)
    return star.select(
        "account_id", "customer_id", "country_id", "country_name", "gender", "age", "age_bucket",
        F.col("product_name").alias("product_category"),
        F.col("refurb_status").alias("product_tier"),
        "account_status",
        F.lit(0.0).alias("financed_amount"),
        F.lit(0.0).alias("outstanding_balance"),
        F.lit(0.0).alias("arrears_balance"),
        F.lit(0).alias("days_past_due"),
        F.col("is_currently_in_arrears").alias("is_in_arrears"),
        F.lit(0).alias("is_default"),
        "payment_type",
        F.lit(0.0).alias("repayment_progress"),
        "account_age_days",
        F.current_timestamp().alias("created_at"),
    )


def _sales_star(fact, dim_country, dim_product, dim_lead_source):
    source = dim_lead_source.select(F.col("lead_source_id").alias("source_key"), "lead_source_name")
    star = left_lookup(fact, _country(dim_country), [("country_id", "country_key")])
    star = left_lookup(star, _product(dim_product), [("product_id", "product_key")], "sale_id")
    return left_lookup(star, source, [("lead_source_id", "source_key")])


def mart_sales_performance(fact_sales: DataFrame, dim_country: DataFrame, dim_product: DataFrame,
                           dim_lead_source: DataFrame, dim_employee: DataFrame) -> DataFrame:
    agent = dim_employee.select(F.col("employee_id").alias("agent_key"), "full_name")
    star = _sales_star(fact_sales, dim_country, dim_product, dim_lead_source)
    star = left_lookup(star, agent, [("agent_id", "agent_key")], "sale_id")
    return star.select(
        "sale_id", "sale_date", "country_id", "country_name", "product_id", "product_name",
        product_tier_of_status(F.col("refurb_status")).alias("product_tier"),
        "lead_source_id", "lead_source_name", "agent_id",
        text_or_empty(F.col("full_name")).alias("agent_name"),
        "account_id", "customer_id", "account_type", "account_status",
        F.lit("").alias("payment_type"), "created_at",
    )


def sales_with_placeholders(fact_sales: DataFrame, dim_country: DataFrame, dim_product: DataFrame,
                            dim_lead_source: DataFrame) -> DataFrame:
    """Variant of the sales mart with constant quantity and money columns."""
    star = _sales_star(fact_sales, dim_country, dim_product, dim_lead_source)
    return star.select(
        "sale_id", "sale_date", "country_id", "country_name", "product_name",
        F.col("refurb_status").alias("product_category"), "lead_source_name",
        F.lit("").alias("payment_type"),
        F.lit(1).alias("quantity"),
        F.lit(0.0).alias("total_sale_amount"),
        F.lit(0.0).alias("financed_amount"),
        F.current_timestamp().alias("created_at"),
    )


def mart_installation_operations(fact_installations: DataFrame, dim_country: DataFrame,
                                 dim_product: DataFrame, dim_employee: DataFrame,
                                 dim_department: DataFrame) -> DataFrame:
    # Employee and department are joined to each other first: both are small next to the fact.
    department = dim_department.select(
        F.col("department_id").alias("department_key"), "department_name")
    engineer = left_lookup(
        dim_employee.select(F.col("employee_id").alias("engineer_key"), "full_name",
                            "department_id"),
        department, [("department_id", "department_key")])
    star = left_lookup(fact_installations, _country(dim_country), [("country_id", "country_key")])
    star = left_lookup(star, _product(dim_product), [("product_id", "product_key")],
                       "installation_id")
    star = left_lookup(star, engineer, [("engineer_id", "engineer_key")], "installation_id")
    return star.select(
        "installation_id", "account_id", "customer_id", "country_id", "country_name", "product_id",
        "product_name",
        product_tier_of_status(F.col("refurb_status")).alias("product_tier"),
        "engineer_id",
        text_or_empty(F.col("full_name")).alias("installer_name"),
        text_or_empty(F.col("department_name")).alias("installer_department"),
        "sale_date", "installation_date",
        calendar_days(F.col("installation_date"), F.col("sale_date"))
        .alias("installation_delay_days"),
        "installation_status", "created_at",
    )
