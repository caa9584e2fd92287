"""Registered tables of the load: dimensions, facts, marts, account and customer tables."""

from __future__ import annotations

from bindings.registry import d, f32, query, t
from bindings.sheets import warehouse
from ledgerfield.operators.describe import row_and_column_counts
from ledgerfield.plans import facts, marts

# Each query runs the table's own plan over its inputs; the inputs are written tables.


def _plan(name: str):
    return lambda spark, root: warehouse(spark, root).plan(name)


query("e01_dim_country", "SELECT * FROM dim_country")(_plan("dim_country"))
query("e02_dim_location", "SELECT * FROM dim_location")(_plan("dim_location"))
query("e03_dim_customer", f"""
SELECT * REPLACE ({d('date_of_birth')}, {t('created_at')}) FROM dim_customer""")(_plan("dim_customer"))
query("e04_dim_product", f"SELECT * REPLACE ({t('created_at')}) FROM dim_product")(
    _plan("dim_product"))
query("e05_dim_lead_source", "SELECT * FROM dim_lead_source")(_plan("dim_lead_source"))
query("e06_dim_department", "SELECT * FROM dim_department")(_plan("dim_department"))
query("e06_dim_employee", f"SELECT * REPLACE ({t('created_at')}) FROM dim_employee")(
    _plan("dim_employee"))
query("e07_dim_account_status", "SELECT * FROM dim_account_status")(_plan("dim_account_status"))

query("e08_fact_sales", f"""
SELECT * REPLACE ({d('sale_date')}, {t('sale_timestamp')}, {t('created_at')}) FROM fact_sales""")(
    _plan("fact_sales"))
query("e09_fact_accounts_snapshots", f"""
SELECT * REPLACE ({d('activation_date')}, {t('created_at')}) FROM fact_accounts_snapshots""")(
    _plan("fact_accounts_snapshots"))
query("e10_fact_installations", f"""
SELECT * REPLACE ({d('sale_date')}, {d('installation_date')}, {t('created_at')})
FROM fact_installations""")(_plan("fact_installations"))
query("e11_fact_lead_funnel", f"""
SELECT * REPLACE ({d('lead_created_date')}, {f32('lead_quality_score')}) FROM fact_lead_funnel""")(
    _plan("fact_lead_funnel"))


@query("e12_fact_lead_funnel_numeric", f"""
SELECT * REPLACE ({d('lead_created_date')}, {f32('lead_quality_score')})
FROM fact_lead_funnel_numeric""")
def lead_funnel_numeric(spark, root):
    # The load time differs on every run.
    return warehouse(spark, root).plan("fact_lead_funnel_numeric").drop("created_at")


query("e13_mart_customer_account_analytics", f"""
SELECT * REPLACE ({d('activation_date')}, {t('created_at')}) FROM mart_customers""")(
    _plan("mart_customer_account_analytics"))
query("e14_mart_sales_performance", f"""
SELECT * REPLACE ({d('sale_date')}, {t('created_at')}) FROM mart_sales""")(
    _plan("mart_sales_performance"))
query("e15_mart_installation_operations", f"""
SELECT * REPLACE ({d('sale_date')}, {d('installation_date')}, {t('created_at')})
FROM mart_installs""")(_plan("mart_installation_operations"))


@query("e16_customer_account_with_placeholders", """
SELECT account_id, customer_id, country_id, country_name, gender, age, age_bucket,
  product_name AS product_category, dp.refurb_status AS product_tier, account_status,
  0.0e0 AS financed_amount, 0.0e0 AS outstanding_balance, 0.0e0 AS arrears_balance,
  0 AS days_past_due, is_in_arrears, 0 AS is_default, payment_type, 0.0e0 AS repayment_progress,
  account_age_days
FROM mart_customers LEFT JOIN (SELECT product_id, refurb_status FROM dim_product) dp
  USING (product_id)""")
def customer_placeholders(spark, root):
    w = warehouse(spark, root)
    return marts.customer_account_with_placeholders(
        w["fact_accounts_snapshots"], w["dim_customer"], w["dim_country"], w["dim_product"],
        w["dim_account_status"]).drop("created_at")


@query("e16_sales_with_placeholders", f"""
SELECT sale_id, {d('sale_date')}, country_id, country_name, product_name,
  dp.refurb_status AS product_category, lead_source_name, '' AS payment_type, 1 AS quantity,
  0.0e0 AS total_sale_amount, 0.0e0 AS financed_amount
FROM mart_sales LEFT JOIN (SELECT product_id, refurb_status FROM dim_product) dp
  USING (product_id)""")
def sales_placeholders(spark, root):
    w = warehouse(spark, root)
    return marts.sales_with_placeholders(
        w["fact_sales"], w["dim_country"], w["dim_product"], w["dim_lead_source"]) \
        .drop("created_at")


ACCOUNT_COLUMNS = """account_id, customer_id, lead_id, sale_id, installation_id, product_id,
  agent_id, engineer_id, country_name, gender, age, age_bucket, location, account_status,
  payment_type, lead_source, product_name, product_tier, product_category, account_age_days,
  is_in_arrears, is_default, is_healthy, installation_delay_days, days_to_sale, product_tier_ord,
  financed_amount, outstanding_balance, arrears_balance, days_past_due, repayment_progress"""

query("e17_account_table", f"""
SELECT {ACCOUNT_COLUMNS}, {t('account_created_at')}, {t('sale_date')}, {t('installation_date')}
FROM account_table""")(_plan("account_table"))
query("e18_customer_aggregate", "SELECT * FROM customer_aggregate")(_plan("customer_aggregate"))
query("e19_customer_table", "SELECT * FROM customer_table")(_plan("customer_table"))


@query("a34_funnel_quality_summary", """
SELECT count(*) AS total_rows, CAST(sum(converted_to_account) AS BIGINT) AS to_account,
  avg(converted_to_account) AS to_account_share, CAST(sum(converted_to_sale) AS BIGINT) AS to_sale,
  avg(converted_to_sale) AS to_sale_share,
  CAST(sum(converted_to_installation) AS BIGINT) AS to_installation,
  avg(converted_to_installation) AS to_installation_share,
  count(*) FILTER (lead_source_id = 0) AS unknown_lead_source,
  count(*) FILTER (country_id = 0) AS unknown_country,
  count(*) FILTER (employee_id = '') AS missing_employee,
  count(*) FILTER (days_to_account = 0) AS zero_days_to_account,
  avg(lead_quality_score) AS avg_lead_quality_score
FROM fact_lead_funnel_numeric""")
def funnel_quality(spark, root):
    return facts.funnel_quality_summary(warehouse(spark, root)["fact_lead_funnel_numeric"])


@query("k07_row_counts_after_load", """
SELECT 'dim_customer' AS "table", count(*) AS rows, 10 AS columns FROM dim_customer
UNION ALL SELECT 'fact_sales', count(*), 12 FROM fact_sales
UNION ALL SELECT 'fact_accounts_snapshots', count(*), 11 FROM fact_accounts_snapshots
UNION ALL SELECT 'fact_installations', count(*), 11 FROM fact_installations
UNION ALL SELECT 'fact_lead_funnel', count(*), 12 FROM fact_lead_funnel
UNION ALL SELECT 'mart_customer_account_analytics', count(*), 18 FROM mart_customers""")
def loaded_rows(spark, root):
    w = warehouse(spark, root)
    names = ["dim_customer", "fact_sales", "fact_accounts_snapshots", "fact_installations",
             "fact_lead_funnel", "mart_customer_account_analytics"]
    return row_and_column_counts({n: w[n] for n in names})
