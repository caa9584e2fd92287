"""Registered analytical queries over the written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindings.registry import d, query
from bindings.sheets import REGIONS, warehouse
from bindings.sql import rate
from ledgerfield.operators.quality import date_order_counts
from ledgerfield.plans import campaigns, customers, fulfilment, funnel, growth, insights, portfolio
from ledgerfield.sources.readers import read_parquet


def segment_labels(spark, root: str) -> DataFrame:
    """Segments by market segment, so that the SQL side labels alike."""
    market = F.col("c_mktsegment")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    titles = ["Stable Premium Growers", "Reliable Mid-Tier", "Early-Tenure Builders",
              "Distressed Defaulters"]
    sid, title = F.when(market == names[0], 0), F.when(market == names[0], titles[0])
    for i in range(1, 4):
        sid, title = sid.when(market == names[i], i), title.when(market == names[i], titles[i])
    return read_parquet(spark, f"{root}/customer.parquet").select(
        F.expr("concat(if(c_custkey % 59 = 0, 'D', 'C'), c_custkey)").alias("customer_id"),
        sid.otherwise(4).alias("segment_id"),
        title.otherwise("Arrears-Stressed PAYG").alias("segment_name"))


def segmented(spark, root: str) -> DataFrame:
    return customers.with_segments(warehouse(spark, root)["customer_table"],
                                   segment_labels(spark, root))


def customer_table(spark, root: str) -> DataFrame:
    return warehouse(spark, root)["customer_table"]


# --- KPIs and customer filters -----------------------------------------------------------------

KPI = f"""count(*) AS customers, {rate('is_in_arrears')} AS arrears_rate_pct,
  {rate('is_default')} AS default_rate_pct,
  round_even(avg(repayment_progress), 3) AS avg_repayment_progress,
  round_even(avg(financed_amount), 0) AS avg_financed_proxy"""


@query("q01_portfolio_kpis", f"SELECT {KPI} FROM customer_table")
def kpis(spark, root):
    return portfolio.portfolio_kpis(customer_table(spark, root))["overall"]


@query("q01_portfolio_kpis_of_country",
       f"SELECT {KPI} FROM customer_table WHERE lower(country_name) = 'kenya'")
def kpis_of_country(spark, root):
    return portfolio.portfolio_kpis(customer_table(spark, root), " Kenya ")["overall"]


@query("q01_portfolio_kpis_by_country", f"""
SELECT country_name, count(customer_id) AS customers, {rate('is_in_arrears')} AS arrears_pct
FROM customer_table GROUP BY 1""")
def kpis_by_country(spark, root):
    return portfolio.portfolio_kpis(customer_table(spark, root))["by_country"]


@query("q01_portfolio_kpis_by_payment_type", f"""
SELECT payment_type, count(customer_id) AS customers, {rate('is_in_arrears')} AS arrears_pct
FROM customer_table GROUP BY 1""")
def kpis_by_payment(spark, root):
    return portfolio.portfolio_kpis(customer_table(spark, root))["by_payment_type"]


_LEVEL = f"""count(*) AS customers, {rate('is_in_arrears')} AS arrears_pct,
  {rate('is_default')} AS default_pct,
  round_even(avg(repayment_progress), 3) AS avg_repayment_progress,
  round_even(avg(financed_amount), 0) AS avg_financed_proxy FROM customer_table"""


@query("q01_portfolio_kpi_table", f"""
SELECT 'overall' AS level, 'all' AS label, {_LEVEL}
UNION ALL SELECT 'country', country_name, {_LEVEL} GROUP BY country_name
UNION ALL SELECT 'payment_type', payment_type, {_LEVEL} GROUP BY payment_type""")
def kpi_table(spark, root):
    return portfolio.portfolio_kpi_table(customer_table(spark, root))


_FILTER = """lower(country_name) = 'uganda' AND upper(payment_type) = 'PAYG' AND is_in_arrears = 0
  AND regexp_matches(coalesce(segment_name, ''), '(?i)stable|tier')"""
_FILTERS = dict(country="UGANDA", payment_type="payg", in_arrears=False, segment_name="stable|tier")


@query("q02_customer_query_summary", f"""
SELECT count(*) AS matched, coalesce({rate('is_in_arrears')}, 0) AS arrears_rate_pct,
  coalesce({rate('is_default')}, 0) AS default_rate_pct FROM segmented WHERE {_FILTER}""")
def customer_summary(spark, root):
    return portfolio.customer_query(segmented(spark, root), **_FILTERS)["summary"]


@query("q02_customer_query_no_match", """
SELECT count(*) AS matched, 0.0e0 AS arrears_rate_pct, 0.0e0 AS default_rate_pct
FROM customer_table WHERE lower(country_name) = 'atlantis'""")
def customer_no_match(spark, root):
    return portfolio.customer_query(customer_table(spark, root), country="Atlantis")["summary"]


@query("q02_customer_query_sample", f"""
SELECT customer_id, country_name, payment_type, product_tier, account_status, is_in_arrears,
  is_default, repayment_progress, financed_amount, segment_name
FROM segmented WHERE {_FILTER} ORDER BY customer_id LIMIT 50""")
def customer_sample(spark, root):
    return portfolio.customer_query(segmented(spark, root), limit=500, **_FILTERS)["sample"]


@query("q03_segment_list", f"""
SELECT segment_id, segment_name, count(customer_id) AS customers,
  {rate('is_in_arrears')} AS arrears_pct, {rate('is_default')} AS default_pct,
  avg(repayment_progress) AS avg_repayment, avg(financed_amount) AS avg_financed
FROM segmented GROUP BY 1, 2""")
def segment_list(spark, root):
    return portfolio.segment_list(segmented(spark, root))


@query("q04_arrears_by_country",
       f"SELECT country_name, {rate('is_in_arrears')} AS is_in_arrears FROM customer_table GROUP BY 1")
def arrears_by_country(spark, root):
    return portfolio.arrears_by(customer_table(spark, root), "country_name")


@query("q05_arrears_by_payment_type",
       f"SELECT payment_type, {rate('is_in_arrears')} AS is_in_arrears FROM customer_table GROUP BY 1")
def arrears_by_payment(spark, root):
    return portfolio.arrears_by(customer_table(spark, root), "payment_type")


@query("q06_segments_overview", f"""
SELECT segment_name, count(customer_id) AS customers, {rate('is_in_arrears')} AS arrears_pct
FROM segmented WHERE segment_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1""")
def segments_overview(spark, root):
    return portfolio.segments_overview(segmented(spark, root))


# --- Growth --------------------------------------------------------------------------------------

_PIVOT = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (country_name = '{r}'), 0) AS BIGINT) AS \"{r}\"" for r in REGIONS)
_GROWTH = ", ".join(
    f"(\"{r}\" - lag(\"{r}\") OVER w) * 100e0 / nullif(lag(\"{r}\") OVER w, 0) "
    f"AS \"{r}_growth_pct\"" for r in REGIONS)


@query("q07_quarterly_growth_table", f"""
SELECT strftime(quarter, '%Y-%m-%d') AS quarter, {', '.join(f'"{r}"' for r in REGIONS)}, {_GROWTH}
FROM (SELECT quarter, {_PIVOT} FROM (
  SELECT CAST(date_trunc('quarter', sale_date) AS DATE) AS quarter, country_name, count(*) AS n
  FROM fact_sales JOIN dim_country USING (country_id) WHERE sale_date IS NOT NULL GROUP BY 1, 2)
  GROUP BY 1) WINDOW w AS (ORDER BY quarter)""")
def quarterly_table(spark, root):
    w = warehouse(spark, root)
    return growth.quarterly_growth_table(w["fact_sales"], w["dim_country"], REGIONS)


_QOQ = """
SELECT country_name, yr, qtr, period, sales, qoq_pct FROM (
  SELECT *, (sales - lag(sales) OVER w) * 100e0 / lag(sales) OVER w AS qoq_pct FROM (
    SELECT country_name, CAST(year(sale_date) AS INTEGER) AS yr,
      CAST(quarter(sale_date) AS INTEGER) AS qtr,
      year(sale_date) || '-Q' || quarter(sale_date) AS period, count(*) AS sales
    FROM mart_sales WHERE sale_date IS NOT NULL GROUP BY ALL)
  WINDOW w AS (PARTITION BY country_name ORDER BY yr, qtr)) WHERE qoq_pct IS NOT NULL"""


@query("q08_quarterly_growth", _QOQ)
def quarterly(spark, root):
    return growth.quarterly_growth(warehouse(spark, root)["mart_sales_performance"])


_PERIODS = [f"{y}-Q{q}" for y in range(1995, 2002) for q in range(1, 5)]


@query("q08_quarterly_growth_heat_table", f"""
SELECT country_name, {', '.join(
    f"max(qoq_pct) FILTER (period = '{p}') AS \"{p}\"" for p in _PERIODS)}
FROM ({_QOQ}) GROUP BY 1""")
def heat_table(spark, root):
    return growth.quarterly_growth_heat_table(
        warehouse(spark, root)["mart_sales_performance"], _PERIODS)


@query("q09_monthly_sales_rolling_mean", """
SELECT country_name, strftime(month, '%Y-%m-%d') AS month, sales,
  avg(sales) OVER (PARTITION BY country_name ORDER BY month
    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_mean
FROM (SELECT country_name, date_trunc('month', sale_date) AS month, count(*) AS sales
  FROM mart_sales WHERE sale_date IS NOT NULL GROUP BY 1, 2)""")
def monthly(spark, root):
    return growth.monthly_sales(warehouse(spark, root)["mart_sales_performance"])


@query("q10_monthly_sales_table", f"""
SELECT strftime(month, '%Y-%m-%d') AS month, {_PIVOT} FROM (
  SELECT date_trunc('month', sale_date) AS month, country_name, count(*) AS n
  FROM fact_sales JOIN dim_country USING (country_id) WHERE sale_date IS NOT NULL GROUP BY 1, 2)
GROUP BY 1""")
def monthly_table(spark, root):
    w = warehouse(spark, root)
    return growth.monthly_sales_table(w["fact_sales"], w["dim_country"], REGIONS)


@query("q16_date_ranges", f"""
SELECT 'fact_sales' AS "table", 'sale_date' AS "column", {d('min(sale_date)', 'first')},
  {d('max(sale_date)', 'last')} FROM fact_sales
UNION ALL SELECT 'fact_installations', 'sale_date', {d('min(sale_date)', 'a')},
  {d('max(sale_date)', 'b')} FROM fact_installations
UNION ALL SELECT 'fact_installations', 'installation_date', {d('min(installation_date)', 'a')},
  {d('max(installation_date)', 'b')} FROM fact_installations
UNION ALL SELECT 'fact_lead_funnel', 'lead_created_date', {d('min(lead_created_date)', 'a')},
  {d('max(lead_created_date)', 'b')} FROM fact_lead_funnel""")
def date_ranges(spark, root):
    w = warehouse(spark, root)
    return growth.date_ranges(w["fact_sales"], w["fact_installations"], w["fact_lead_funnel"])


@query("q22_lead_source_mix", """
SELECT country_name, lead_source_name, count(*) AS sales_count FROM mart_sales GROUP BY 1, 2
ORDER BY 1, 3 DESC, 2""")
def source_mix(spark, root):
    return growth.lead_source_mix(warehouse(spark, root)["mart_sales_performance"])


# --- Fulfilment ----------------------------------------------------------------------------------

@query("q12_backlog_by_country", """
SELECT country_name, count(*) AS uninstalled_sales FROM fact_sales s JOIN dim_country USING (country_id)
WHERE NOT EXISTS (SELECT 1 FROM fact_installations i WHERE i.account_id = s.account_id) GROUP BY 1""")
def backlog(spark, root):
    w = warehouse(spark, root)
    return fulfilment.backlog_by_country(w["fact_sales"], w["fact_installations"],
                                         w["dim_country"])


_DELAY = "date_diff('day', sale_date, installation_date)"


@query("q13_valid_delays_by_country", f"""
SELECT country_name, count(*) AS installed_count, avg({_DELAY}) AS avg_delay,
  quantile_cont({_DELAY}, 0.5) AS median_delay
FROM fact_installations JOIN dim_country USING (country_id) WHERE {_DELAY} >= 0 GROUP BY 1""")
def valid_delays(spark, root):
    w = warehouse(spark, root)
    return fulfilment.valid_delays_by_country(w["fact_installations"], w["dim_country"])


@query("q14_negative_delays_by_country", f"""
SELECT country_name, count(*) FILTER ({_DELAY} < 0) AS negative_delays, count(*) AS total,
  count(*) FILTER ({_DELAY} < 0) * 100e0 / count(*) AS pct_negative
FROM fact_installations JOIN dim_country USING (country_id) GROUP BY 1""")
def negative_delays(spark, root):
    w = warehouse(spark, root)
    return fulfilment.negative_delays_by_country(w["fact_installations"], w["dim_country"])


@query("q17_delay_table", f"""
SELECT strftime(date_trunc('month', sale_date), '%Y-%m-%d') AS month, {', '.join(
    f"coalesce(avg({_DELAY}) FILTER (country_name = '{r}'), 0) AS \"{r}\"" for r in REGIONS)}
FROM fact_installations JOIN dim_country USING (country_id)
WHERE (installation_status = 'Installed' OR installation_date IS NOT NULL)
  AND sale_date IS NOT NULL GROUP BY 1""")
def delay_table(spark, root):
    w = warehouse(spark, root)
    return fulfilment.delay_table(w["fact_installations"], w["dim_country"], REGIONS)


@query("q18_status_table", f"""
SELECT installation_status, {', '.join(
    f"count(*) FILTER (country_name = '{r}') AS \"{r}\"" for r in REGIONS)}
FROM fact_installations JOIN dim_country USING (country_id)
WHERE installation_status IS NOT NULL GROUP BY 1""")
def status_table(spark, root):
    w = warehouse(spark, root)
    return fulfilment.status_table(w["fact_installations"], w["dim_country"], REGIONS)


@query("q20_delay_distribution", """
SELECT b.country_name, bin, count(*) AS count, min(low) AS low, min(high) AS high,
  min(median_delay) AS median_delay
FROM (SELECT m.country_name, low, high, median_delay, CAST(CASE WHEN high = low THEN 1 ELSE
    least(floor((installation_delay_days - low) * 30 / (high - low)) + 1, 30) END AS INTEGER) AS bin
  FROM mart_installs m JOIN (SELECT country_name, min(installation_delay_days)::DOUBLE AS low,
      max(installation_delay_days)::DOUBLE AS high,
      quantile_cont(installation_delay_days, 0.5) AS median_delay
    FROM mart_installs WHERE installation_delay_days BETWEEN -30 AND 90 GROUP BY 1) USING (country_name)
  WHERE installation_delay_days BETWEEN -30 AND 90) b GROUP BY 1, 2""")
def delay_distribution(spark, root):
    return fulfilment.delay_distribution(warehouse(spark, root)["mart_installation_operations"])


@query("q28_sales_and_installations", """
SELECT 'sales' AS measure, count(*) AS value FROM fact_sales
UNION ALL SELECT 'installations', count(*) FROM fact_installations
UNION ALL SELECT 'sales_without_installation', count(*) FROM fact_sales
  WHERE account_id NOT IN (SELECT account_id FROM fact_installations WHERE account_id IS NOT NULL)
UNION ALL SELECT 'installations_without_sale', count(*) FROM fact_installations
  WHERE account_id NOT IN (SELECT account_id FROM fact_sales WHERE account_id IS NOT NULL)""")
def reconcile(spark, root):
    w = warehouse(spark, root)
    return fulfilment.reconcile(w["fact_sales"], w["fact_installations"])


_RAW = """(SELECT a.id, CAST(s.sale_date AS VARCHAR) AS sold,
  TRY_CAST(s.sale_date AS TIMESTAMP) AS sale_date, a.installation_id AS "Installation_id",
  TRY_CAST(i.installation_date AS TIMESTAMP) AS installation_date,
  CAST(floor((epoch_us(TRY_CAST(i.installation_date AS TIMESTAMP))
    - epoch_us(TRY_CAST(s.sale_date AS TIMESTAMP))) / 86400000000.0) AS INTEGER) AS delay
  FROM s_accounts a JOIN s_sales s ON a.id = s.account_id
  JOIN s_installations i ON a.installation_id = i.id)"""


@query("q30_raw_delay_statistics", f"""
SELECT 'delay' AS "column", count(delay) AS count, avg(delay) AS mean, stddev_samp(delay) AS std,
  min(delay)::DOUBLE AS min, quantile_cont(delay, 0.25) AS q25, quantile_cont(delay, 0.5) AS q50,
  quantile_cont(delay, 0.75) AS q75, max(delay)::DOUBLE AS max,
  count(*) FILTER (delay IS NULL) AS nulls FROM {_RAW}""")
def raw_delay_statistics(spark, root):
    return fulfilment.raw_delay_statistics(warehouse(spark, root).sheets())


@query("q30_raw_delay_samples", f"""
SELECT id, strftime(sale_date, '%Y-%m-%d %H:%M:%S') AS sale_date, "Installation_id",
  strftime(installation_date, '%Y-%m-%d %H:%M:%S') AS installation_date, delay, kind FROM (
  (SELECT *, 'negative' AS kind FROM {_RAW} WHERE delay < 0 ORDER BY id LIMIT 5)
  UNION ALL (SELECT *, 'valid' AS kind FROM {_RAW} WHERE delay >= 0 ORDER BY id LIMIT 5))""")
def raw_delay_samples(spark, root):
    return fulfilment.raw_delay_samples(warehouse(spark, root).sheets())


@query("q30_raw_delay_sign_counts", f"""
SELECT count(*) FILTER (delay < 0) AS negative, count(*) FILTER (delay >= 0) AS valid,
  round_even(avg(delay), 4) AS mean_delay FROM {_RAW}""")
def delay_signs(spark, root):
    return fulfilment.delay_sign_counts(warehouse(spark, root).sheets())


@query("j17_customer_timeline", """
SELECT c.id AS customer_id, c.region, a.id AS account_id, left(c.created_at, 10) AS customer_created,
  strftime(TRY_CAST(l.created_at AS TIMESTAMP), '%Y-%m-%d') AS lead_created,
  left(a.created_at, 10) AS account_created,
  strftime(TRY_CAST(s.sale_date AS TIMESTAMP), '%Y-%m-%d') AS sale_date, i.installation_date,
  a.dispatch_date AS dispatched, a.first_installment_date AS first_installment
FROM s_customers c JOIN s_accounts a ON c.id = a.customer_id LEFT JOIN s_leads l ON a.lead_id = l.id
  LEFT JOIN s_sales s ON a.id = s.account_id LEFT JOIN s_installations i ON a.installation_id = i.id""")
def timeline(spark, root):
    return fulfilment.customer_timeline(warehouse(spark, root).sheets())


@query("v07_date_order_counts", """
SELECT count(*) AS total, count(*) FILTER (sale_date > installation_date) AS sale_after_install,
  count(*) FILTER (sale_date = installation_date) AS sale_equals_install,
  count(*) FILTER (sale_date < installation_date) AS sale_before_install FROM fact_installations""")
def date_order(spark, root):
    return date_order_counts(warehouse(spark, root)["fact_installations"], "sale_date",
                             "installation_date")


# --- Funnel --------------------------------------------------------------------------------------

@query("q11_conversion_by_country", """
SELECT country_name, count(lead_id) AS total_leads,
  CAST(sum(converted_to_sale) AS BIGINT) AS sales_from_leads, avg(lead_quality_score) AS avg_quality,
  avg(days_to_sale) AS avg_days_to_sale,
  sum(converted_to_sale) * 100e0 / count(lead_id) AS conversion_rate
FROM fact_lead_funnel JOIN (SELECT customer_id, country_id FROM dim_customer) USING (customer_id)
  JOIN dim_country USING (country_id) GROUP BY 1""")
def conversion(spark, root):
    w = warehouse(spark, root)
    return funnel.conversion_by_country(w["fact_lead_funnel"], w["dim_customer"], w["dim_country"])


def _by_source(spark, root):
    w = warehouse(spark, root)
    return funnel.funnel_by_source(w["fact_lead_funnel"], w["dim_lead_source"])


_STAGES = """(SELECT *, least(raw_installation, to_sale) AS to_installation FROM (
  SELECT *, least(raw_sale, to_account) AS to_sale FROM (
  SELECT *, least(raw_account, total_leads) AS to_account FROM (
    SELECT lead_source_name AS lead_source, count(DISTINCT lead_id) AS total_leads,
      count(*) FILTER (customer_id <> '') AS raw_account,
      count(*) FILTER (converted_to_sale = 1 AND customer_id <> '') AS raw_sale,
      count(*) FILTER (converted_to_installation = 1 AND customer_id <> '') AS raw_installation,
      round_even(avg(days_to_account) FILTER (days_to_account > 0), 1) AS avg_days_to_account,
      round_even(avg(days_to_sale) FILTER (days_to_sale > 0), 1) AS avg_days_to_sale,
      round_even(avg(days_to_dispatch) FILTER (days_to_dispatch > 0), 1) AS avg_days_to_dispatch
    FROM fact_lead_funnel JOIN dim_lead_source USING (lead_source_id) GROUP BY 1))))"""


@query("q23_funnel_by_source", f"""
SELECT lead_source, total_leads, to_account, to_sale, to_installation, avg_days_to_account,
  avg_days_to_sale, avg_days_to_dispatch,
  round_even(to_account * 100e0 / total_leads, 1) AS cr_lead_to_account,
  coalesce(round_even(to_sale * 100e0 / nullif(to_account, 0), 1), 0) AS cr_account_to_sale,
  coalesce(round_even(to_installation * 100e0 / nullif(to_sale, 0), 1), 0) AS cr_sale_to_installation
FROM {_STAGES}""")
def by_source(spark, root):
    return _by_source(spark, root)


@query("q24_overall_funnel", f"""
SELECT stage_order, stage, n AS count, round_even(n * 100e0 / first_value(n) OVER w, 1) AS pct_of_top,
  coalesce(abs(n - lag(n) OVER w), 0) AS drop_off FROM (
  SELECT 1 AS stage_order, 'Total Leads' AS stage, CAST(sum(total_leads) AS BIGINT) AS n FROM {_STAGES}
  UNION ALL SELECT 2, 'Converted to Account', CAST(sum(to_account) AS BIGINT) FROM {_STAGES}
  UNION ALL SELECT 3, 'Converted to Sale', CAST(sum(to_sale) AS BIGINT) FROM {_STAGES}
  UNION ALL SELECT 4, 'Installed', CAST(sum(to_installation) AS BIGINT) FROM {_STAGES})
WINDOW w AS (ORDER BY stage_order)""")
def overall(spark, root):
    return funnel.overall_funnel(_by_source(spark, root))


@query("v06_conversion_rate_checks", f"""
SELECT c AS "check", 'error' AS severity, CAST(v AS BIGINT) AS violations, v = 0 AS passed FROM (
  SELECT 'cr_lead_to_account at most 100' AS c, count(*) FILTER (to_account > total_leads) AS v
    FROM {_STAGES}
  UNION ALL SELECT 'cr_account_to_sale at most 100', count(*) FILTER (to_sale > to_account) FROM {_STAGES}
  UNION ALL SELECT 'cr_sale_to_installation at most 100',
    count(*) FILTER (to_installation > to_sale) FROM {_STAGES})""")
def conversion_checks(spark, root):
    return funnel.conversion_rate_checks(_by_source(spark, root))


@query("q25_funnel_summary", """
SELECT count(*) AS total_rows, CAST(sum(converted_to_account) AS BIGINT) AS sum_conv_acc,
  CAST(sum(converted_to_sale) AS BIGINT) AS sum_conv_sale,
  CAST(sum(converted_to_installation) AS BIGINT) AS sum_conv_inst,
  avg(lead_quality_score) AS avg_quality,
  count(*) FILTER (lead_quality_score > 0) AS positive_quality_count FROM fact_lead_funnel""")
def funnel_summary(spark, root):
    return funnel.funnel_summary(warehouse(spark, root)["fact_lead_funnel"])


@query("q25_conversion_times", """
SELECT avg(days_to_account) AS avg_days_acc, avg(days_to_sale) AS avg_days_sale,
  avg(days_to_dispatch) AS avg_days_disp FROM fact_lead_funnel WHERE converted_to_sale = 1""")
def conversion_times(spark, root):
    return funnel.conversion_times(warehouse(spark, root)["fact_lead_funnel"])


# The sentinel is a parameter: 0 days occurs in the data, 99999 does not.
@query("q26_step_days_by_country", " UNION ALL ".join(f"""
SELECT country_name, '{c}' AS metric, count(*) AS total_records,
  count(*) FILTER ({c} = 0) AS sentinel_count, count(*) FILTER ({c} <> 0) AS valid_count,
  avg(nullif({c}, 0)) AS avg_valid_days, quantile_cont(nullif({c}, 0), 0.5) AS median_valid_days
FROM fact_lead_funnel JOIN (SELECT customer_id, country_id FROM dim_customer) USING (customer_id)
  JOIN dim_country USING (country_id) GROUP BY 1""" for c in funnel.STEP_DAYS))
def step_days(spark, root):
    w = warehouse(spark, root)
    return funnel.step_days_by_country(w["fact_lead_funnel"], w["dim_customer"], w["dim_country"],
                                       sentinel=0)


@query("v08_sentinel_shares", " UNION ALL ".join(f"""
SELECT '{c}' AS metric, count(*) AS total, count(*) FILTER ({c} = 0) AS sentinels,
  count(*) FILTER ({c} = 0) * 100e0 / count(*) AS share_pct FROM fact_lead_funnel"""
                                               for c in funnel.STEP_DAYS))
def sentinels(spark, root):
    return funnel.sentinel_shares(warehouse(spark, root)["fact_lead_funnel"], sentinel=0)


@query("q29_lead_quality_range", """
SELECT round(min(lead_quality_score)::DOUBLE, 6) AS min_quality,
  round(max(lead_quality_score)::DOUBLE, 6) AS max_quality, avg(lead_quality_score) AS avg_quality,
  count(*) AS leads FROM fact_lead_funnel""")
def quality_range(spark, root):
    return funnel.lead_quality_range(warehouse(spark, root)["fact_lead_funnel"])


# --- Credit risk ---------------------------------------------------------------------------------

@query("q15_credit_risk_by_country", """
SELECT country_name, count(*) AS total_accounts,
  count(*) FILTER (is_currently_in_arrears) AS in_arrears, avg(account_age_days) AS avg_account_age,
  count(*) FILTER (is_currently_in_arrears) * 100e0 / count(*) AS arrears_rate
FROM fact_accounts_snapshots JOIN dim_country USING (country_id) GROUP BY 1""")
def credit_risk(spark, root):
    w = warehouse(spark, root)
    return portfolio.credit_risk_by_country(w["fact_accounts_snapshots"], w["dim_country"])


@query("q19_arrears_flag_table", f"""
SELECT is_currently_in_arrears, {', '.join(
    f"count(*) FILTER (country_name = '{r}') AS \"{r}\"" for r in REGIONS)}
FROM fact_accounts_snapshots JOIN dim_country USING (country_id) GROUP BY 1""")
def arrears_flags(spark, root):
    w = warehouse(spark, root)
    return portfolio.arrears_flag_table(w["fact_accounts_snapshots"], w["dim_country"], REGIONS)


_TIER_RATE = "round_even(count(*) FILTER (is_in_arrears) / count(*) * 100, 1)"


@query("q21_arrears_by_country_and_tier", f"""
SELECT country_name, product_tier, count(*) FILTER (is_in_arrears) AS in_arrears,
  count(*) AS total, {_TIER_RATE} AS arrears_rate_pct FROM mart_customers GROUP BY 1, 2""")
def tier_rates(spark, root):
    return portfolio.arrears_by_country_and_tier(
        warehouse(spark, root)["mart_customer_account_analytics"])


@query("q21_arrears_tier_table", f"""
SELECT country_name, coalesce(max(r) FILTER (product_tier = 'New'), 0) AS "New",
  coalesce(max(r) FILTER (product_tier = 'Refurbished'), 0) AS "Refurbished"
FROM (SELECT country_name, product_tier, {_TIER_RATE} AS r FROM mart_customers GROUP BY 1, 2)
GROUP BY 1""")
def tier_table(spark, root):
    return portfolio.arrears_tier_table(
        warehouse(spark, root)["mart_customer_account_analytics"], ["New", "Refurbished"])


@query("q27_product_risk_by_country", """
SELECT coalesce(country_name, 'Unknown') AS country_name, fa.product_id, product_name,
  count(*) AS total, count(*) FILTER (is_currently_in_arrears) AS in_arrears,
  count(*) FILTER (is_currently_in_arrears) * 100e0 / count(*) AS arrears_rate
FROM fact_accounts_snapshots fa LEFT JOIN dim_country dc ON fa.country_id = dc.country_id
  LEFT JOIN dim_product dp ON fa.product_id = dp.product_id GROUP BY 1, 2, 3""")
def product_risk(spark, root):
    w = warehouse(spark, root)
    return portfolio.product_risk_by_country(w["fact_accounts_snapshots"], w["dim_country"],
                                             w["dim_product"])


@query("q29_account_age_details", """
SELECT min(account_age_days) AS min_age, max(account_age_days) AS max_age,
  avg(account_age_days) AS avg_age, count(*) FILTER (account_age_days > 0) AS non_zero_count,
  count(*) AS total FROM fact_accounts_snapshots""")
def account_age(spark, root):
    return portfolio.account_age_details(warehouse(spark, root)["fact_accounts_snapshots"])


@query("q40_arrears_by_country_and_payment", """
SELECT country_name, avg(is_in_arrears) FILTER (payment_type = 'PAYG') AS "PAYG",
  avg(is_in_arrears) FILTER (payment_type = 'CASH') AS "CASH" FROM customer_table GROUP BY 1""")
def arrears_payment(spark, root):
    return portfolio.arrears_by_country_and_payment(customer_table(spark, root), ["PAYG", "CASH"])


# --- Campaigns and insights ----------------------------------------------------------------------

def _scores(where: str) -> str:
    return f"""(SELECT *, 0.35e0 * stability_score + 0.25e0 * affluence_score + 0.15e0 * growth_score
    + 0.15e0 * size_score + 0.1e0 * low_default_score - 0.5e0 * arrears_rate - 0.4e0 * default_rate
    AS campaign_score
  FROM (SELECT *, customers / max(customers) OVER () AS size_score, stability AS stability_score,
      affluence / max(affluence) OVER () AS affluence_score,
      1 - greatest(least(growth / max(growth) OVER (), 1), 0) AS growth_score,
      1 - default_rate AS low_default_score
    FROM (SELECT segment_id, segment_name, count(customer_id) AS customers,
        avg(repayment_progress) AS stability, avg(financed_amount) AS affluence,
        avg(account_age_days) AS growth, avg(is_default) AS default_rate,
        avg(is_in_arrears) AS arrears_rate, avg(CAST(payment_type = 'PAYG' AS INTEGER)) AS payg_share
      FROM segmented WHERE segment_id IS NOT NULL AND {where} GROUP BY 1, 2)))"""


_KENYA = _scores("lower(country_name) = 'kenya'")


@query("q31_campaign_scores", f"SELECT * FROM {_KENYA}")
def campaign_scores(spark, root):
    return campaigns.campaign_scores(segmented(spark, root), "Kenya")


@query("q31_campaign_scores_without_country", f"SELECT * FROM {_scores('true')}")
def campaign_scores_all(spark, root):
    return campaigns.campaign_scores(segmented(spark, root), "Atlantis")


_TOP = f"""(SELECT * FROM {_KENYA} ORDER BY CASE WHEN arrears_rate <= 0.15e0 AND default_rate <= 0.1e0
  AND stability >= 0.55e0 THEN 0 ELSE 1 END, campaign_score DESC, segment_id LIMIT 2)"""


@query("q32_top_two_segments", f"SELECT * FROM {_TOP}")
def top_two(spark, root):
    return campaigns.top_two_segments(campaigns.campaign_scores(segmented(spark, root), "Kenya"))


@query("q33_rejected_segments", f"""
SELECT segment_id, segment_name, avg(is_in_arrears) AS arrears, avg(is_default) AS "default"
FROM segmented WHERE lower(country_name) = 'kenya' AND segment_id IS NOT NULL
  AND segment_id NOT IN (SELECT segment_id FROM {_TOP}) GROUP BY 1, 2""")
def rejected(spark, root):
    return campaigns.rejected_segments(segmented(spark, root), "Kenya")


@query("t38_campaign_archetypes", """
SELECT DISTINCT segment_id, segment_name, CASE WHEN segment_name LIKE '%Stable Premium%'
    OR segment_name LIKE '%Reliable%' THEN 'proven_grower'
  WHEN segment_name LIKE '%Early-Tenure%' THEN 'step_up' ELSE 'conservative' END AS archetype
FROM segmented WHERE segment_id IS NOT NULL""")
def archetypes(spark, root):
    scores = campaigns.campaign_scores(segmented(spark, root), "Atlantis")
    return campaigns.with_archetype(scores.select("segment_id", "segment_name"))


@query("q39_segment_cards", """
SELECT segment_id, segment_name, count(*) AS customers,
  count(*) * 100e0 / (SELECT count(*) FROM segmented) AS pct_of_portfolio,
  avg(repayment_progress) AS avg_repayment, avg(is_in_arrears) * 100 AS arrears_pct,
  avg(is_default) * 100 AS default_pct, avg(financed_amount) AS avg_financed,
  avg(account_age_days) AS avg_account_age
FROM segmented WHERE segment_id IS NOT NULL GROUP BY 1, 2""")
def cards(spark, root):
    return campaigns.segment_cards(segmented(spark, root))


@query("q39_segment_top_countries", """
SELECT segment_id, value, customers, CAST(rank AS INTEGER) AS rank FROM (
  SELECT segment_id, country_name AS value, count(*) AS customers,
    row_number() OVER (PARTITION BY segment_id ORDER BY count(*) DESC, country_name) AS rank
  FROM segmented WHERE segment_id IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3""")
def top_countries(spark, root):
    return campaigns.segment_value_counts(segmented(spark, root), "country_name", 3)


@query("q39_segment_payment_mix", """
SELECT segment_id, payment_type AS value, count(*) AS customers FROM segmented
WHERE segment_id IS NOT NULL GROUP BY 1, 2""")
def payment_mix(spark, root):
    return campaigns.segment_value_counts(segmented(spark, root), "payment_type")


_R1 = """SELECT 'R1' AS id, 'PAYG arrears beside the portfolio' AS title,
  'payment_type = ''PAYG'' AND is_in_arrears = 1' AS filter, 'PAYG' AS subject,
  avg(is_in_arrears) FILTER (payment_type = 'PAYG') * 100 AS subject_pct,
  count(*) FILTER (payment_type = 'PAYG') AS subject_n, 'portfolio' AS other,
  avg(is_in_arrears) * 100 AS other_pct, count(*) AS other_n, CAST(NULL AS DOUBLE) AS extra_pct
FROM customer_table"""


def _extremes(column: str, least: int) -> str:
    return f"""(SELECT {column} AS k, avg(is_in_arrears) AS r, count(*) AS n,
    row_number() OVER (ORDER BY avg(is_in_arrears) DESC, {column}) AS high,
    row_number() OVER (ORDER BY avg(is_in_arrears), {column}) AS low
  FROM customer_table WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) >= {least})"""


_R2 = f"""SELECT 'R2' AS id, 'Highest arrears by product tier: ' || a.k AS title,
  'product_tier = ''' || a.k || '''' AS filter, a.k AS subject, a.r * 100 AS subject_pct,
  a.n AS subject_n, b.k AS other, b.r * 100 AS other_pct, b.n AS other_n,
  (a.r - b.r) * 100 AS extra_pct
FROM {_extremes('product_tier', 0)} a JOIN {_extremes('product_tier', 0)} b
  ON a.high = 1 AND b.low = 1"""
_R3 = f"""SELECT 'R3' AS id,
  'Highest and lowest arrears by lead source' AS title,
  'lead_source = ''' || a.k || '''' AS filter, a.k AS subject, a.r * 100 AS subject_pct,
  a.n AS subject_n, b.k AS other, b.r * 100 AS other_pct, b.n AS other_n,
  CAST(NULL AS DOUBLE) AS extra_pct
FROM {_extremes('lead_source', 30)} a JOIN {_extremes('lead_source', 30)} b
  ON a.high = 1 AND b.low = 1"""
_R4 = """SELECT 'R4' AS id,
  'Arrears after long and short delays' AS title,
  'installation_delay_days > ' || CAST(round(any_value(p75), 2) AS VARCHAR) AS filter, 'above P75' AS subject,
  avg(is_in_arrears) FILTER (d >= 0 AND d > p75) * 100 AS subject_pct,
  count(*) FILTER (d >= 0 AND d > p75) AS subject_n, 'up to median' AS other,
  avg(is_in_arrears) FILTER (d >= 0 AND d <= p50) * 100 AS other_pct,
  count(*) FILTER (d >= 0 AND d <= p50) AS other_n,
  avg(CAST(d < 0 AS INTEGER)) * 100 AS extra_pct
FROM (SELECT is_in_arrears, installation_delay_days AS d FROM customer_table)
  CROSS JOIN (SELECT quantile_cont(installation_delay_days, 0.75) AS p75,
    quantile_cont(installation_delay_days, 0.5) AS p50 FROM customer_table
    WHERE installation_delay_days >= 0)"""


@query("q34_payg_against_portfolio", _R1)
def r1(spark, root):
    return insights.payg_against_portfolio(customer_table(spark, root))


@query("q35_worst_tier_against_best", _R2)
def r2(spark, root):
    return insights.worst_tier_against_best(customer_table(spark, root))


@query("q36_worst_source_against_best", _R3)
def r3(spark, root):
    return insights.worst_source_against_best(customer_table(spark, root))


@query("q37_long_delays_against_short", _R4)
def r4(spark, root):
    return insights.long_delays_against_short(customer_table(spark, root))


@query("q38_collection_insights", f"{_R1} UNION ALL {_R2} UNION ALL {_R3} UNION ALL {_R4}")
def all_insights(spark, root):
    return insights.collection_insights(customer_table(spark, root))


