"""Dimension tables from the raw sheets.

Surrogate keys are computed from natural keys, so no table is written and read back to learn them,
and a fact can derive a key without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerfield.functions.buckets import age_bucket_adult, age_by_calendar_year
from ledgerfield.functions.dates import parse_date, parse_timestamp
from ledgerfield.functions.keys import currency, product_tier, risk_category, surrogate_key


def country_key(region: Column) -> Column:
    return surrogate_key(region)


def location_key(region: Column, location: Column) -> Column:
    return surrogate_key(region, location)


def dim_country(customers: DataFrame) -> DataFrame:
    regions = customers.select("region").where("region IS NOT NULL").distinct()
    return regions.select(
        country_key(F.col("region")).alias("country_id"),
        F.col("region").alias("country_name"),
        currency(F.col("region")).alias("currency"),
    )


def dim_location(customers: DataFrame) -> DataFrame:
    pairs = customers.select("region", "Location").na.drop().distinct()
    return pairs.select(
        location_key(F.col("region"), F.col("Location")).alias("location_id"),
        country_key(F.col("region")).alias("country_id"),
        F.col("Location").alias("location_name"),
    )


def dim_customer(customers: DataFrame, reference_date: str) -> DataFrame:
    """Customers with a country and a location. Ages are taken at the reference date."""
    birth = parse_date(F.col("Date_of_birth"))
    age = age_by_calendar_year(birth, F.lit(reference_date).cast("date"))
    known = customers.where("region IS NOT NULL AND Location IS NOT NULL")
    return known.select(
        F.col("id").cast("string").alias("customer_id"),
        F.col("Gender").alias("gender"),
        birth.alias("date_of_birth"),
        age.alias("age"),
        age_bucket_adult(age).alias("age_bucket"),
        country_key(F.col("region")).alias("country_id"),
        location_key(F.col("region"), F.col("Location")).alias("location_id"),
        F.coalesce(F.col("Latitude").cast("double"), F.lit(0.0)).alias("latitude"),
        F.coalesce(F.col("Longitude").cast("double"), F.lit(0.0)).alias("longitude"),
        parse_timestamp(F.col("created_at")).alias("created_at"),
    )


def dim_product(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("Id").cast("string").alias("product_id"),
        F.col("Product").alias("product_name"),
        product_tier(F.col("is_refurb")).alias("refurb_status"),
        parse_timestamp(F.col("created_at")).alias("created_at"),
    )


def dim_lead_source(leads: DataFrame) -> DataFrame:
    sources = leads.select("Source").where("Source IS NOT NULL").distinct()
    return sources.select(
        surrogate_key(F.col("Source")).alias("lead_source_id"),
        F.col("Source").alias("lead_source_name"),
    )


def dim_department(departments: DataFrame) -> DataFrame:
    return departments.select(
        F.col("Id").cast("string").alias("department_id"),
        F.col("name").alias("department_name"),
    )


def dim_employee(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("Id").cast("string").alias("employee_id"),
        F.col("Name").alias("full_name"),
        F.col("departmentId").cast("string").alias("department_id"),
        parse_timestamp(F.col("created_at")).alias("created_at"),
    )


def dim_account_status(accounts: DataFrame) -> DataFrame:
    statuses = accounts.select("status").where("status IS NOT NULL").distinct()
    return statuses.select(
        surrogate_key(F.col("status")).alias("account_status_id"),
        F.col("status").alias("account_status_name"),
        risk_category(F.col("status")).alias("risk_category"),
    )
