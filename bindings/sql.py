"""DuckDB SQL for the sheets and the tables built from them, as named CTEs."""

from __future__ import annotations

import re

from bindings.sheets import REFERENCE_DATE


def key(*parts: str) -> str:
    """UUID-shaped key of a natural key."""
    text = " || '|' || ".join(f"({p})" for p in parts)
    h = f"sha256({text})"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' "
            f"|| substr({h}, 17, 4) || '-' || substr({h}, 21, 12))")


def ts(column: str) -> str:
    return f"TRY_CAST({column} AS TIMESTAMP)"


def day(column: str) -> str:
    return f"CAST(TRY_CAST({column} AS TIMESTAMP) AS DATE)"


def elapsed(end: str, start: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS INTEGER)"


def rate(flag: str, places: int = 2) -> str:
    return f"round_even(avg({flag}) * 100, {places})"


REGION = ("CASE n_regionkey WHEN 0 THEN 'kenya' WHEN 1 THEN 'uganda' WHEN 2 THEN 'civ' "
          "WHEN 3 THEN 'europe' ELSE 'middle east' END")
STAMP = "'%Y-%m-%d %H:%M:%S'"
DATE = "'%Y-%m-%d'"

CTES: dict[str, str] = {}

CTES["first_lines"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey
                           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) = 1"""

CTES["s_customers"] = f"""
SELECT 'C' || c_custkey AS id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END
    AS gender,
  CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN 'unknown'
    ELSE CAST(DATE '1930-01-01' + CAST(c_custkey * 37 % 29000 AS INTEGER) AS VARCHAR) END
    AS date_of_birth,
  CASE WHEN c_custkey % 97 <> 0 THEN {REGION} END AS region,
  CASE WHEN c_custkey % 89 <> 0 THEN n_name END AS location,
  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 100.0 END AS latitude,
  c_acctbal / -50.0 AS longitude,
  strftime(TIMESTAMP '1994-01-01 08:00:00' + to_days(CAST(c_custkey % 300 AS INTEGER)), {STAMP})
    AS created_at
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

CTES["s_departments"] = "SELECT 'D' || n_nationkey AS id, n_name AS name FROM nation"

CTES["s_users"] = f"""
SELECT 'U' || s_suppkey AS id, s_name AS name, 'D' || s_nationkey AS department_id,
  strftime(TIMESTAMP '1994-06-01' + to_days(CAST(s_suppkey % 60 AS INTEGER)), {STAMP}) AS created_at
FROM supplier"""

CTES["s_products"] = f"""
SELECT 'P' || p_partkey AS id, p_name AS product,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN true WHEN p_type = 'PROMO' THEN NULL
    ELSE false END AS is_refurb,
  strftime(TIMESTAMP '1994-01-01' + to_days(CAST(p_partkey % 30 AS INTEGER)), {STAMP}) AS created_at
FROM part"""

CTES["s_leads"] = f"""
SELECT 'LEAD-' || o_orderkey AS id,
  CASE WHEN o_orderkey % 37 <> 0 THEN 'C' || o_custkey END AS customer_id,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 'Billboard'
    ELSE ['Roadshow', 'Refer and Earn', 'Facebook', 'Website', 'Walk-in']
      [CAST(left(o_orderpriority, 1) AS INTEGER)] END AS source,
  CASE WHEN o_orderkey % 211 = 0 THEN 'bad' ELSE strftime(
    o_orderdate - to_days(CAST(o_orderkey % 120 AS INTEGER))
    + to_hours(CAST(o_orderkey % 24 AS INTEGER))
    + to_days(CASE WHEN o_orderkey % 29 = 0 THEN 130 ELSE 0 END), {STAMP}) END AS created_at
FROM orders"""

CTES["s_accounts"] = f"""
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'B' ELSE 'A' END || o_orderkey AS id, 'C' || o_custkey AS customer_id,
  CASE WHEN o_orderkey % 307 = 0 THEN NULL
    WHEN o_orderstatus = 'F' THEN ['Complete', 'Advance', 'Refunded']
      [CAST(o_orderkey % 3 + 1 AS INTEGER)]
    WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 11 = 0 THEN 'Arrears'
      WHEN o_orderkey % 17 = 0 THEN 'No Deposit' ELSE 'Complete' END
    WHEN o_orderkey % 19 = 0 THEN 'Write Off' WHEN o_orderkey % 23 = 0 THEN 'Repossession'
    WHEN o_orderkey % 29 = 0 THEN 'Repossed' ELSE 'Advance' END AS status,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PAYG' ELSE 'CASH' END AS type,
  strftime(o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) + to_hours(6), {STAMP})
    AS created_at,
  CASE WHEN l_orderkey IS NOT NULL AND o_orderkey % 13 <> 0 THEN 'I' || o_orderkey END
    AS installation_id,
  CASE WHEN o_orderkey % 19 <> 0 THEN
    strftime(o_orderdate + to_days(CAST(o_orderkey % 30 - 5 AS INTEGER)), {DATE}) END
    AS dispatch_date,
  CASE WHEN o_orderkey % 23 <> 0 THEN strftime(o_orderdate + to_days(30), {DATE}) END
    AS first_installment_date,
  'U' || l_suppkey AS agent_id, 'P' || l_partkey AS product_id,
  CASE WHEN o_orderkey % 61 <> 0 AND o_orderkey % 10 <> 0 THEN 'LEAD-' || o_orderkey END AS lead_id
FROM orders LEFT JOIN first_lines ON o_orderkey = l_orderkey"""

CTES["s_sales"] = f"""
SELECT 'S' || o_orderkey AS id,
  CASE WHEN o_orderkey % 17 = 0 THEN 'N' ELSE 'A' END || o_orderkey AS account_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE strftime(o_orderdate, {DATE}) END AS sale_date,
  strftime(o_orderdate + to_hours(9), {STAMP}) AS created_at
FROM orders"""

CTES["s_installations"] = f"""
SELECT 'I' || l_orderkey AS id,
  CASE WHEN l_orderkey % 31 <> 0 THEN strftime(l_shipdate, {DATE}) END AS installation_date,
  'U' || l_suppkey AS engineer_id, strftime(l_shipdate + to_days(1), {STAMP}) AS created_at
FROM first_lines"""

CTES["dim_country"] = f"""
SELECT DISTINCT {key('region')} AS country_id, region AS country_name,
  CASE region WHEN 'uganda' THEN 'USh' WHEN 'kenya' THEN 'KSh' WHEN 'civ' THEN 'CFA Franc'
    ELSE 'KES' END AS currency
FROM s_customers WHERE region IS NOT NULL"""

CTES["dim_location"] = f"""
SELECT DISTINCT {key('region', 'location')} AS location_id, {key('region')} AS country_id,
  location AS location_name
FROM s_customers WHERE region IS NOT NULL AND location IS NOT NULL"""

CTES["dim_customer"] = f"""
SELECT customer_id, gender, date_of_birth, age,
  CASE WHEN age > 0 AND age <= 18 THEN '0-18' WHEN age > 18 AND age <= 35 THEN '19-35'
    WHEN age > 35 AND age <= 50 THEN '36-50' WHEN age > 50 AND age <= 100 THEN '51+' END
    AS age_bucket,
  country_id, location_id, latitude, longitude, created_at
FROM (SELECT id AS customer_id, gender, {day('date_of_birth')} AS date_of_birth,
    coalesce(year(DATE '{REFERENCE_DATE}') - year({day('date_of_birth')}), 0) AS age,
    {key('region')} AS country_id, {key('region', 'location')} AS location_id,
    coalesce(latitude, 0) AS latitude, coalesce(longitude, 0) AS longitude,
    {ts('created_at')} AS created_at
  FROM s_customers WHERE region IS NOT NULL AND location IS NOT NULL)"""

CTES["dim_product"] = f"""
SELECT id AS product_id, product AS product_name,
  CASE WHEN is_refurb THEN 'Refurbished' ELSE 'New' END AS refurb_status,
  {ts('created_at')} AS created_at
FROM s_products"""

CTES["dim_lead_source"] = f"""
SELECT DISTINCT {key('source')} AS lead_source_id, source AS lead_source_name
FROM s_leads WHERE source IS NOT NULL"""

CTES["dim_department"] = "SELECT id AS department_id, name AS department_name FROM s_departments"

CTES["dim_employee"] = f"""
SELECT id AS employee_id, name AS full_name, department_id, {ts('created_at')} AS created_at
FROM s_users"""

CTES["dim_account_status"] = f"""
SELECT DISTINCT {key('status')} AS account_status_id, status AS account_status_name,
  CASE WHEN status IN ('Arrears', 'Repossession', 'Repossed', 'Write Off') THEN 'High Risk'
    ELSE 'Low Risk' END AS risk_category
FROM s_accounts WHERE status IS NOT NULL"""

CTES["fact_sales"] = f"""
SELECT s.id AS sale_id, a.customer_id, a.product_id, {key('l.source')} AS lead_source_id,
  a.agent_id, s.account_id, {key('c.region')} AS country_id, {day('s.sale_date')} AS sale_date,
  {ts('s.created_at')} AS sale_timestamp, coalesce(a.type, '') AS account_type,
  coalesce(a.status, '') AS account_status, {ts('s.created_at')} AS created_at
FROM s_sales s LEFT JOIN s_accounts a ON s.account_id = a.id
  LEFT JOIN s_leads l ON a.lead_id = l.id LEFT JOIN s_customers c ON a.customer_id = c.id
WHERE c.region IS NOT NULL AND l.source IS NOT NULL"""

CTES["sold_leads"] = """
SELECT lead_id, source FROM (
  SELECT a.lead_id, l.source, row_number() OVER (PARTITION BY a.lead_id ORDER BY s.id) AS rn
  FROM s_sales s JOIN s_accounts a ON s.account_id = a.id LEFT JOIN s_leads l ON a.lead_id = l.id
  WHERE a.lead_id IS NOT NULL) WHERE rn = 1"""

CTES["fact_accounts_snapshots"] = f"""
SELECT a.id AS account_id, a.customer_id, a.product_id, {key('c.region')} AS country_id,
  coalesce({key('o.source')}, '') AS lead_source_id, {key('a.status')} AS account_status_id,
  {day('a.first_installment_date')} AS activation_date,
  {elapsed(ts('a.created_at'), f"min({ts('a.created_at')}) OVER (PARTITION BY a.id)")}
    AS account_age_days,
  a.type AS payment_type, a.status = 'Arrears' AS is_currently_in_arrears,
  {ts('a.created_at')} AS created_at
FROM s_accounts a LEFT JOIN s_customers c ON a.customer_id = c.id
  LEFT JOIN sold_leads o ON a.lead_id = o.lead_id
WHERE c.region IS NOT NULL AND a.status IS NOT NULL"""

CTES["fact_installations"] = f"""
SELECT i.id AS installation_id, a.customer_id, a.id AS account_id, a.product_id, i.engineer_id,
  c.country_id, coalesce(c.location_id, c.country_id) AS location_id,
  {day('s.sale_date')} AS sale_date, {day('i.installation_date')} AS installation_date,
  a.status AS installation_status, {ts('i.created_at')} AS created_at
FROM s_installations i LEFT JOIN s_accounts a ON i.id = a.installation_id
  LEFT JOIN dim_customer c ON a.customer_id = c.customer_id
  LEFT JOIN s_sales s ON a.id = s.account_id
WHERE c.country_id IS NOT NULL"""


def _positive(end: str, start: str) -> str:
    days = elapsed(end, start)
    return f"CASE WHEN {days} >= 0 THEN {days} END"


CTES["fact_lead_funnel"] = f"""
SELECT l.id AS lead_id, coalesce(l.customer_id, '') AS customer_id,
  {key('l.source')} AS lead_source_id, a.agent_id, {day('l.created_at')} AS lead_created_date,
  CAST(a.id IS NOT NULL AS INTEGER) AS converted_to_account,
  CAST(s.id IS NOT NULL AS INTEGER) AS converted_to_sale,
  CAST(a.installation_id IS NOT NULL AS INTEGER) AS converted_to_installation,
  {_positive(ts('a.created_at'), ts('l.created_at'))} AS days_to_account,
  {_positive(ts('s.sale_date'), ts('l.created_at'))} AS days_to_sale,
  {_positive(ts('a.dispatch_date'), ts('l.created_at'))} AS days_to_dispatch,
  CAST(0.4e0 * CAST(a.id IS NOT NULL AS INTEGER) + 0.3e0 * CAST(s.id IS NOT NULL AS INTEGER)
    + 0.3e0 * CAST(a.installation_id IS NOT NULL AS INTEGER) AS FLOAT) AS lead_quality_score
FROM s_leads l LEFT JOIN s_accounts a ON l.id = a.lead_id
  LEFT JOIN s_sales s ON a.id = s.account_id
WHERE l.source IS NOT NULL"""


def _clamped(end: str, start: str) -> str:
    days = elapsed(end, start)
    return f"CASE WHEN {days} < 0 THEN 0 ELSE {days} END"


CTES["fact_lead_funnel_numeric"] = f"""
SELECT *, CAST(round_even(least(0.4e0 * converted_to_account + 0.3e0 * converted_to_sale
    + 0.2e0 * converted_to_installation + CASE WHEN days_to_account IS NOT NULL
      THEN 0.1e0 * greatest(0e0, 1e0 - days_to_account / 90e0) ELSE 0e0 END, 1e0), 6) AS FLOAT)
    AS lead_quality_score
FROM (SELECT TRY_CAST(replace(l.id, 'LEAD-', '') AS BIGINT) AS lead_id,
    coalesce(l.customer_id, '') AS customer_id,
    CASE l.source WHEN 'Roadshow' THEN 1 WHEN 'Refer and Earn' THEN 2 WHEN 'Facebook' THEN 3
      WHEN 'Website' THEN 4 WHEN 'Walk-in' THEN 5 WHEN 'Telesales' THEN 6
      WHEN 'Door to Door' THEN 7 WHEN 'Partners' THEN 8 ELSE 0 END AS lead_source_id,
    coalesce(a.agent_id, '') AS employee_id,
    CASE lower(c.region) WHEN 'kenya' THEN 1 WHEN 'uganda' THEN 2 WHEN 'civ' THEN 3 ELSE 0 END
      AS country_id,
    {day('l.created_at')} AS lead_created_date,
    CAST(a.id IS NOT NULL AS INTEGER) AS converted_to_account,
    CAST({ts('s.sale_date')} IS NOT NULL AS INTEGER) AS converted_to_sale,
    CAST({ts('i.installation_date')} IS NOT NULL AS INTEGER) AS converted_to_installation,
    {_clamped(ts('a.created_at'), ts('l.created_at'))} AS days_to_account,
    {_clamped(ts('s.sale_date'), ts('l.created_at'))} AS days_to_sale,
    {_clamped(ts('i.installation_date'), ts('l.created_at'))} AS days_to_installation
  FROM s_leads l LEFT JOIN s_accounts a ON l.id = a.lead_id
    LEFT JOIN s_sales s ON a.id = s.account_id
    LEFT JOIN s_installations i ON a.installation_id = i.id
    LEFT JOIN s_customers c ON l.customer_id = c.id)"""

CTES["mart_customers"] = """
SELECT fa.account_id, fa.customer_id, fa.country_id, dc.country_name, cu.gender, cu.age,
  cu.age_bucket, fa.product_id, dp.product_name,
  CASE WHEN dp.refurb_status = 'Refurbished' THEN 'Refurbished' ELSE 'New' END AS product_tier,
  fa.account_status_id, st.account_status_name AS account_status, st.risk_category,
  fa.payment_type, fa.is_currently_in_arrears AS is_in_arrears, fa.account_age_days,
  fa.activation_date, fa.created_at
FROM fact_accounts_snapshots fa LEFT JOIN dim_customer cu ON fa.customer_id = cu.customer_id
  LEFT JOIN dim_country dc ON fa.country_id = dc.country_id
  LEFT JOIN dim_product dp ON fa.product_id = dp.product_id
  LEFT JOIN dim_account_status st ON fa.account_status_id = st.account_status_id"""

CTES["mart_sales"] = """
SELECT fs.sale_id, fs.sale_date, fs.country_id, dc.country_name, fs.product_id, dp.product_name,
  CASE WHEN dp.refurb_status = 'Refurbished' THEN 'Refurbished' ELSE 'New' END AS product_tier,
  fs.lead_source_id, ls.lead_source_name, fs.agent_id, coalesce(de.full_name, '') AS agent_name,
  fs.account_id, fs.customer_id, fs.account_type, fs.account_status, '' AS payment_type,
  fs.created_at
FROM fact_sales fs LEFT JOIN dim_country dc ON fs.country_id = dc.country_id
  LEFT JOIN dim_product dp ON fs.product_id = dp.product_id
  LEFT JOIN dim_lead_source ls ON fs.lead_source_id = ls.lead_source_id
  LEFT JOIN dim_employee de ON fs.agent_id = de.employee_id"""

CTES["mart_installs"] = """
SELECT fi.installation_id, fi.account_id, fi.customer_id, fi.country_id, dc.country_name,
  fi.product_id, dp.product_name,
  CASE WHEN dp.refurb_status = 'Refurbished' THEN 'Refurbished' ELSE 'New' END AS product_tier,
  fi.engineer_id, coalesce(de.full_name, '') AS installer_name,
  coalesce(dd.department_name, '') AS installer_department, fi.sale_date, fi.installation_date,
  CAST(date_diff('day', fi.sale_date, fi.installation_date) AS INTEGER) AS installation_delay_days,
  fi.installation_status, fi.created_at
FROM fact_installations fi LEFT JOIN dim_country dc ON fi.country_id = dc.country_id
  LEFT JOIN dim_product dp ON fi.product_id = dp.product_id
  LEFT JOIN dim_employee de ON fi.engineer_id = de.employee_id
  LEFT JOIN dim_department dd ON de.department_id = dd.department_id"""

CTES["account_base"] = f"""
SELECT a.id AS account_id, a.customer_id, a.lead_id, s.id AS sale_id, a.installation_id,
  a.product_id, a.agent_id, i.engineer_id,
  CASE lower(trim(c.region)) WHEN 'kenya' THEN 'Kenya' WHEN 'uganda' THEN 'Uganda'
    WHEN 'civ' THEN 'Côte d''Ivoire' WHEN 'europe' THEN 'Europe'
    WHEN 'middle east' THEN 'Middle East' ELSE 'Unknown' END AS country_name,
  c.gender, CAST(round_even(greatest(least({elapsed('r.reference', ts('c.date_of_birth'))}
    / 365.25e0, 90e0), 18e0), 0) AS INTEGER) AS raw_age,
  {ts('c.date_of_birth')} IS NOT NULL AS has_birth, c.location, a.status AS account_status,
  a.type AS payment_type,
  CASE WHEN l.customer_id = a.customer_id THEN l.source END AS lead_source,
  p.product AS product_name, CASE WHEN p.is_refurb THEN 'Refurbished' ELSE 'New' END AS product_tier,
  {ts('a.created_at')} AS account_created_at, {ts('s.sale_date')} AS sale_date,
  {ts('i.installation_date')} AS installation_date,
  greatest({elapsed('r.reference', ts('a.created_at'))}, 0) AS account_age_days,
  CAST(coalesce(a.status IN ('Arrears', 'No Deposit'), false) AS INTEGER) AS is_in_arrears,
  CAST(coalesce(a.status IN ('Write Off', 'Repossession', 'Repossed'), false) AS INTEGER)
    AS is_default,
  CAST(coalesce(a.status IN ('Complete', 'Advance'), false) AS INTEGER) AS is_healthy,
  {elapsed(ts('i.installation_date'), ts('s.sale_date'))} AS installation_delay_days,
  {_clamped(ts('s.sale_date'), ts('l.created_at'))} AS days_to_sale
FROM s_accounts a LEFT JOIN s_customers c ON a.customer_id = c.id
  LEFT JOIN s_products p ON a.product_id = p.id LEFT JOIN s_sales s ON a.id = s.account_id
  LEFT JOIN s_installations i ON a.installation_id = i.id LEFT JOIN s_leads l ON a.lead_id = l.id
  CROSS JOIN (SELECT max({ts('created_at')}) AS reference FROM s_accounts) r"""

CTES["account_money"] = """
SELECT *, CASE WHEN has_birth THEN raw_age END AS age,
  CASE product_tier WHEN 'New' THEN 3 ELSE 1 END AS product_tier_ord,
  CASE product_tier WHEN 'New' THEN 3 ELSE 1 END
    * CASE WHEN payment_type = 'PAYG' THEN 50000 ELSE 80000 END AS financed_amount
FROM account_base"""

CTES["account_table"] = """
SELECT *, CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 25 THEN '<25' WHEN age < 35 THEN '25-34'
    WHEN age < 50 THEN '35-49' ELSE '50+' END AS age_bucket,
  product_name AS product_category,
  CASE WHEN is_in_arrears = 1 THEN outstanding_balance * 0.4e0 ELSE 0e0 END AS arrears_balance,
  CASE WHEN is_in_arrears = 1
      THEN CAST(trunc(greatest(least(account_age_days * 0.15e0, 90e0), 7e0)) AS INTEGER)
    WHEN is_default = 1 THEN 90 ELSE 0 END AS days_past_due,
  greatest(least(1e0 - outstanding_balance / financed_amount, 1e0), 0e0) AS repayment_progress
FROM (SELECT *, financed_amount * CASE WHEN is_healthy = 1 THEN 0.2e0 WHEN is_default = 1
    THEN 0.9e0 ELSE 0.55e0 END AS outstanding_balance FROM account_money)"""


def _first(column: str) -> str:
    return f"arg_min({column}, account_id) FILTER ({column} IS NOT NULL) AS {column}"


_FIRSTS = ["country_name", "gender", "age", "age_bucket", "location", "account_status",
           "lead_source"]


def _mode(column: str, default: str) -> str:
    return f"coalesce(any_value(m_{column}.v), '{default}') AS {column}"


def _mode_table(column: str) -> str:
    return (f"LEFT JOIN (SELECT id, v FROM (SELECT customer_id AS id, {column} AS v, "
            f"row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {column}) AS rn "
            f"FROM account_table WHERE {column} IS NOT NULL GROUP BY customer_id, {column}) "
            f"WHERE rn = 1) m_{column} ON m_{column}.id = a.customer_id")


CTES["customer_aggregate"] = f"""
SELECT a.customer_id, {', '.join(_first(c) for c in _FIRSTS)},
  count(account_id) AS account_count, CAST(sum(financed_amount) AS BIGINT) AS financed_amount,
  sum(outstanding_balance) AS outstanding_balance, sum(arrears_balance) AS arrears_balance,
  max(days_past_due) AS days_past_due, max(is_in_arrears) AS is_in_arrears,
  max(is_default) AS is_default, max(is_healthy) AS is_healthy,
  max(account_age_days) AS account_age_days, {_mode('payment_type', 'PAYG')},
  {_mode('product_tier', 'New')}, {_mode('product_category', '')},
  quantile_cont(installation_delay_days, 0.5) AS installation_delay_days,
  quantile_cont(days_to_sale, 0.5) AS days_to_sale,
  sum(repayment_progress * CASE outstanding_balance WHEN 0 THEN 1 ELSE outstanding_balance END)
    / sum(CASE outstanding_balance WHEN 0 THEN 1 ELSE outstanding_balance END)
    AS repayment_progress
FROM account_table a {_mode_table('payment_type')} {_mode_table('product_tier')}
  {_mode_table('product_category')}
WHERE a.customer_id IS NOT NULL GROUP BY a.customer_id"""

CTES["customer_risk"] = """
SELECT *, 0.4e0 * is_in_arrears + 0.4e0 * is_default + 0.2e0 * (days_past_due_cap / 90e0)
    AS risk_stress_score
FROM (SELECT *,
    CASE WHEN age >= 0 AND age <= 25 THEN '<25' WHEN age > 25 AND age <= 40 THEN '25-40'
      WHEN age > 40 AND age <= 60 THEN '40-60' WHEN age > 60 AND age <= 100 THEN '60+' END
      AS customer_age_group,
    CASE WHEN account_age_days > -1 AND account_age_days <= 180 THEN '<6m'
      WHEN account_age_days > 180 AND account_age_days <= 365 THEN '6-12m'
      WHEN account_age_days > 365 AND account_age_days <= 730 THEN '1-2y'
      WHEN account_age_days > 730 AND account_age_days <= 10000 THEN '2y+' END AS tenure_bucket,
    coalesce(greatest(least(outstanding_balance / nullif(financed_amount, 0), 2e0), 0e0), 0e0)
      AS outstanding_to_financed,
    coalesce(greatest(least(arrears_balance / nullif(outstanding_balance, 0), 1e0), 0e0), 0e0)
      AS arrears_rate,
    greatest(least(days_past_due, 90), 0) AS days_past_due_cap FROM customer_aggregate)"""

CTES["customer_table"] = """
SELECT c.* REPLACE (coalesce(c.installation_delay_days, m.delay) AS installation_delay_days),
  coalesce(c.days_to_sale, m.days) AS lead_conversion_speed,
  CAST(coalesce(c.installation_delay_days, m.delay) < 0 AS INTEGER) AS install_delay_flag,
  coalesce(q.healthy, 0.5e0) AS lead_quality_score,
  1e0 - account_age_days / CAST(greatest(m.oldest, 1) AS DOUBLE) AS recency_score,
  least(account_count, 3) / 3e0 AS frequency_score,
  (rank() OVER (ORDER BY financed_amount)
    + (count(*) OVER (PARTITION BY financed_amount) - 1) / 2e0) / count(*) OVER () AS monetary_score
FROM customer_risk c
  LEFT JOIN (SELECT lead_source AS src, avg(is_healthy) AS healthy FROM customer_risk
    WHERE lead_source IS NOT NULL GROUP BY 1) q ON q.src = c.lead_source
  CROSS JOIN (SELECT quantile_cont(installation_delay_days, 0.5) AS delay,
    quantile_cont(days_to_sale, 0.5) AS days, max(account_age_days) AS oldest
    FROM customer_risk) m"""

# Segments by rule, so that both engines label alike.
CTES["segments"] = """
SELECT CASE WHEN c_custkey % 59 = 0 THEN 'D' ELSE 'C' END || c_custkey AS customer_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2
    WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS segment_id,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Stable Premium Growers'
    WHEN 'BUILDING' THEN 'Reliable Mid-Tier' WHEN 'FURNITURE' THEN 'Early-Tenure Builders'
    WHEN 'HOUSEHOLD' THEN 'Distressed Defaulters' ELSE 'Arrears-Stressed PAYG' END AS segment_name
FROM customer"""

CTES["segmented"] = """
SELECT c.*, s.segment_id, s.segment_name FROM customer_table c LEFT JOIN segments s USING (customer_id)"""


def with_tables(select: str) -> str:
    """Put the CTEs a query needs, directly or not, in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in needed)
    return f"WITH {head}\n{select.strip()}"
