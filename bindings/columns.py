"""Registered column helpers and frame clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.reports import customer_table, segmented
from bindings.sheets import REFERENCE_DATE, warehouse
from bindings.sql import elapsed, key
from ledgerfield.functions import buckets, dates, keys, money, numbers
from ledgerfield.operators import frames
from ledgerfield.sources.readers import read_parquet


def table(spark, root: str, name: str):
    return read_parquet(spark, f"{root}/{name}.parquet")


def sheet(spark, root: str, name: str):
    return warehouse(spark, root).sheet(name)


# --- Dates ---------------------------------------------------------------------------------------

@query("t01_lenient_timestamps", """
SELECT id, strftime(TRY_CAST(created_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed,
  TRY_CAST(created_at AS TIMESTAMP) IS NULL AS rejected FROM s_leads""")
def lenient(spark, root):
    parsed = dates.parse_timestamp(F.col("created_at"))
    return sheet(spark, root, "Leads").select(
        F.col("Id").alias("id"), parsed.alias("parsed"), parsed.isNull().alias("rejected"))


def _line_dates(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_shipdate")
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumn(
        "ordered", F.expr("o_orderdate + make_dt_interval(0, o_orderkey % 24)"))


_DAYS = elapsed("l_shipdate", "o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))")


@query("t02_t03_t04_t05_day_differences", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_DAYS} AS signed, greatest({_DAYS}, 0) AS clamped,
  CASE WHEN {_DAYS} >= 0 THEN {_DAYS} END AS null_negative,
  date_diff('day', CAST(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS DATE),
    CAST(l_shipdate AS DATE)) AS calendar
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def day_differences(spark, root):
    end, start = F.col("l_shipdate"), F.col("ordered")
    return _line_dates(spark, root).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        dates.elapsed_days(end, start).alias("signed"),
        dates.elapsed_days(end, start, "clamp").alias("clamped"),
        dates.elapsed_days(end, start, "null_negative").alias("null_negative"),
        dates.calendar_days(end, start).alias("calendar"))


@query("t06_t07_t08_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr,
  CAST(quarter(o_orderdate) AS INTEGER) AS qtr,
  year(o_orderdate) || '-Q' || quarter(o_orderdate) AS period,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
  strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def date_parts(spark, root):
    at = F.col("o_orderdate")
    return table(spark, root, "orders").select(
        "o_orderkey", F.year(at).alias("yr"), F.quarter(at).alias("qtr"),
        dates.quarter_label(at).alias("period"), dates.month_start(at).alias("month"),
        dates.quarter_start(at).alias("quarter"), F.to_date(at).alias("day"))


# --- Ages and buckets ----------------------------------------------------------------------------

_BIRTH = "CAST(TRY_CAST(date_of_birth AS TIMESTAMP) AS DATE)"
_AGE = f"""CASE WHEN {_BIRTH} IS NOT NULL THEN CAST(round_even(greatest(least(
  date_diff('day', {_BIRTH}, DATE '{REFERENCE_DATE}') / 365.25e0, 90e0), 18e0), 0) AS INTEGER) END"""


@query("t09_t10_t11_t12_ages", f"""
SELECT id, calendar_age, CASE WHEN calendar_age > 0 AND calendar_age <= 18 THEN '0-18'
    WHEN calendar_age > 18 AND calendar_age <= 35 THEN '19-35'
    WHEN calendar_age > 35 AND calendar_age <= 50 THEN '36-50'
    WHEN calendar_age > 50 AND calendar_age <= 100 THEN '51+' END AS adult_bucket,
  age, CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 25 THEN '<25' WHEN age < 35 THEN '25-34'
    WHEN age < 50 THEN '35-49' ELSE '50+' END AS customer_bucket
FROM (SELECT id, CAST(coalesce(year(DATE '{REFERENCE_DATE}') - year({_BIRTH}), 0) AS INTEGER)
    AS calendar_age, {_AGE} AS age FROM s_customers)""")
def ages(spark, root):
    birth = dates.parse_date(F.col("Date_of_birth"))
    reference = F.lit(REFERENCE_DATE).cast("date")
    calendar, age = buckets.age_by_calendar_year(birth, reference), \
        buckets.age_by_days(birth, reference)
    return sheet(spark, root, "Customers").select(
        "id", calendar.alias("calendar_age"),
        buckets.age_bucket_adult(calendar).alias("adult_bucket"), age.alias("age"),
        buckets.age_bucket_customer(age).alias("customer_bucket"))


def _chain(column: str, bounds: list[tuple[int, int, str]], closed: bool = False) -> str:
    parts = []
    for i, (low, high, label) in enumerate(bounds):
        op = ">=" if closed and i == 0 else ">"
        parts.append(f"WHEN {column} {op} {low} AND {column} <= {high} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


@query("t13_age_group", f"""
SELECT p_partkey, p_size, {_chain('v', [(0, 25, '<25'), (25, 40, '25-40'), (40, 60, '40-60'),
                                        (60, 100, '60+')], True)} AS age_group
FROM (SELECT p_partkey, p_size, p_partkey % 103 AS v FROM part)""")
def age_groups(spark, root):
    return table(spark, root, "part").select(
        "p_partkey", "p_size", buckets.age_group(F.col("p_partkey") % 103).alias("age_group"))


@query("t14_tenure_bucket", f"""
SELECT o_orderkey, {_chain('v', [(-1, 180, '<6m'), (180, 365, '6-12m'), (365, 730, '1-2y'),
                                 (730, 10000, '2y+')])} AS tenure
FROM (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1998-01-01') AS v FROM orders)""")
def tenures(spark, root):
    days = dates.calendar_days(F.lit("1998-01-01").cast("date"), F.col("o_orderdate"))
    return table(spark, root, "orders").select("o_orderkey", buckets.tenure_bucket(days)
                                               .alias("tenure"))


# --- Lookups and keys ----------------------------------------------------------------------------

def _titled(name: str) -> str:
    return (f"array_to_string(list_transform(string_split({name}, ' '), "
            "lambda w: upper(w[1]) || lower(w[2:])), ' ')")


@query("t15_title_case", f"""
SELECT n_nationkey, {_titled("n_name")} || '-' || {_titled("r_name")} || ' O''' ||
  {_titled("string_split(n_name, ' ')[1]")} || '  ' || {_titled("string_split(r_name, ' ')[1]")}
  AS titled
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def title_case(spark, root):
    """Names joined by hyphens, apostrophes and double blanks."""
    joined = table(spark, root, "nation").join(
        table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = [F.substring_index(c, " ", 1) for c in ("n_name", "r_name")]
    name = F.concat("n_name", F.lit("-"), "r_name", F.lit(" o'"), first[0], F.lit("  "), first[1])
    return joined.select("n_nationkey", keys.title_case(F.lower(name)).alias("titled"))


@query("t15_country_display_name", """
SELECT id, CASE lower(trim(upper(region))) WHEN 'kenya' THEN 'Kenya' WHEN 'uganda' THEN 'Uganda'
  WHEN 'civ' THEN 'Côte d''Ivoire' WHEN 'europe' THEN 'Europe' WHEN 'middle east' THEN 'Middle East'
  ELSE 'Unknown' END AS country_name FROM s_customers""")
def display_names(spark, root):
    shouted = F.concat(F.lit("  "), F.upper("region"), F.lit(" "))
    return sheet(spark, root, "Customers").select(
        "id", keys.country_display_name(shouted).alias("country_name"))


@query("t16_lookups_with_default", """
SELECT l.id, CASE l.source WHEN 'Roadshow' THEN 1 WHEN 'Refer and Earn' THEN 2 WHEN 'Facebook' THEN 3
    WHEN 'Website' THEN 4 WHEN 'Walk-in' THEN 5 ELSE 0 END AS source_number,
  CASE c.region WHEN 'uganda' THEN 'USh' WHEN 'kenya' THEN 'KSh' WHEN 'civ' THEN 'CFA Franc'
    ELSE 'KES' END AS currency,
  CASE c.region WHEN 'kenya' THEN 1 WHEN 'uganda' THEN 2 WHEN 'civ' THEN 3 ELSE 0 END
    AS country_number,
  CASE WHEN a.status IN ('Arrears', 'Repossession', 'Repossed', 'Write Off') THEN 'High Risk'
    ELSE 'Low Risk' END AS risk
FROM s_leads l LEFT JOIN s_customers c ON l.customer_id = c.id
  LEFT JOIN s_accounts a ON a.lead_id = l.id""")
def lookups(spark, root):
    leads = sheet(spark, root, "Leads").select("Id", "customer_id", "Source")
    customers = sheet(spark, root, "Customers").select(F.col("id").alias("cid"), "region")
    accounts = sheet(spark, root, "Accounts").select("lead_id", "status")
    joined = leads.join(customers, F.col("customer_id") == F.col("cid"), "left") \
        .join(accounts, F.col("Id") == F.col("lead_id"), "left")
    return joined.select(
        F.col("Id").alias("id"), keys.lead_source_number(F.col("Source")).alias("source_number"),
        keys.currency(F.col("region")).alias("currency"),
        keys.country_number(F.upper("region")).alias("country_number"),
        keys.risk_category(F.col("status")).alias("risk"))


@query("t17_surrogate_keys", f"""
SELECT id, {key('region')} AS country_id, {key('region', 'location')} AS location_id
FROM s_customers""")
def surrogate_keys(spark, root):
    return sheet(spark, root, "Customers").select(
        "id", keys.surrogate_key(F.col("region")).alias("country_id"),
        keys.surrogate_key(F.col("region"), F.col("Location")).alias("location_id"))


@query("t18_strip_prefix", """
SELECT id, TRY_CAST(replace(id, 'LEAD-', '') AS BIGINT) AS number,
  TRY_CAST(replace(source, 'LEAD-', '') AS BIGINT) AS no_number FROM s_leads""")
def strip_prefix(spark, root):
    return sheet(spark, root, "Leads").select(
        F.col("Id").alias("id"), keys.strip_prefix_number(F.col("Id"), "LEAD-").alias("number"),
        keys.strip_prefix_number(F.col("Source"), "LEAD-").alias("no_number"))


@query("t19_product_tier", """
SELECT id, CASE WHEN is_refurb THEN 'Refurbished' ELSE 'New' END AS tier FROM s_products""")
def tiers(spark, root):
    return sheet(spark, root, "Products").select(
        F.col("Id").alias("id"), keys.product_tier(F.col("is_refurb")).alias("tier"))


@query("t34_coalesce_and_sentinel", """
SELECT id, coalesce(region, '') AS region, nullif(location, 'NATION_3') AS location
FROM s_customers""")
def coalesce_sentinel(spark, root):
    return sheet(spark, root, "Customers").select(
        "id", keys.text_or_empty(F.col("region")).alias("region"),
        keys.without_sentinel(F.col("Location"), "NATION_3").alias("location"))


@query("t39_text_or_empty", """
SELECT id, coalesce(product_id, '') AS product_id, coalesce(installation_id, '') AS installation_id,
  coalesce(lead_id, '') AS lead_id FROM s_accounts""")
def text_ids(spark, root):
    return sheet(spark, root, "Accounts").select(
        "id", keys.text_or_empty(F.col("Proudct_id")).alias("product_id"),
        keys.text_or_empty(F.col("Installation_id")).alias("installation_id"),
        keys.text_or_empty(F.col("lead_id")).alias("lead_id"))


# --- Money and scores ----------------------------------------------------------------------------

@query("t20_t21_t22_t23_t24_t25_money_proxies", """
SELECT account_id, product_tier_ord, CAST(payment_type = 'PAYG' AS INTEGER) AS payg, financed_amount,
  outstanding_balance, arrears_balance, days_past_due, repayment_progress FROM account_table""")
def money_proxies(spark, root):
    base = warehouse(spark, root)["account_table"].select(
        "account_id", "product_tier", "payment_type", "is_in_arrears", "is_default", "is_healthy",
        "account_age_days")
    c = F.col
    base = base.withColumn("product_tier_ord", money.tier_ordinal(c("product_tier")))
    base = base.withColumn(
        "financed_amount", money.financed_amount(c("product_tier_ord"), c("payment_type")))
    base = base.withColumn("outstanding_balance", money.outstanding_balance(
        c("financed_amount"), c("is_healthy"), c("is_default")))
    return base.select(
        "account_id", "product_tier_ord", money.is_payg(c("payment_type")).alias("payg"),
        "financed_amount", "outstanding_balance",
        money.arrears_balance(c("outstanding_balance"), c("is_in_arrears"))
        .alias("arrears_balance"),
        money.days_past_due(c("account_age_days"), c("is_in_arrears"), c("is_default"))
        .alias("days_past_due"),
        money.repayment_progress(c("outstanding_balance"), c("financed_amount"))
        .alias("repayment_progress"))


@query("t26_t27_t28_risk_ratios", """
SELECT customer_id, outstanding_to_financed, arrears_rate, risk_stress_score,
  outstanding_balance / CASE WHEN account_count % 3 = 0 THEN 1 ELSE account_count % 3 END
    AS debt_to_income FROM customer_table""")
def risk_ratios(spark, root):
    c = F.col
    return customer_table(spark, root).select(
        "customer_id",
        money.outstanding_to_financed(c("outstanding_balance"), c("financed_amount"))
        .alias("outstanding_to_financed"),
        money.arrears_rate(c("arrears_balance"), c("outstanding_balance")).alias("arrears_rate"),
        money.risk_stress_score(c("is_in_arrears"), c("is_default"),
                                numbers.clip(c("days_past_due"), 0, 90)).alias("risk_stress_score"),
        money.debt_to_income(c("outstanding_balance"), c("account_count") % 3)
        .alias("debt_to_income"))


@query("t29_lead_quality", """
SELECT lead_id, round(lead_quality_score::DOUBLE, 6) AS quality FROM fact_lead_funnel""")
def lead_quality(spark, root):
    funnel = warehouse(spark, root)["fact_lead_funnel"]
    return funnel.select("lead_id", money.lead_quality(
        F.col("converted_to_account"), F.col("converted_to_sale"),
        F.col("converted_to_installation")).alias("quality"))


@query("t30_lead_quality_with_speed", """
SELECT lead_id, round(lead_quality_score::DOUBLE, 6) AS quality FROM fact_lead_funnel_numeric""")
def lead_quality_speed(spark, root):
    funnel = warehouse(spark, root)["fact_lead_funnel_numeric"]
    return funnel.select("lead_id", money.lead_quality_with_speed(
        F.col("converted_to_account"), F.col("converted_to_sale"),
        F.col("converted_to_installation"), F.col("days_to_account")).alias("quality"))


@query("t31_t32_t33_numbers", """
SELECT c_custkey, ln(1 + greatest(c_acctbal, 0)) AS logged,
  coalesce(c_acctbal / nullif(c_custkey % 4, 0), -1) AS divided, round_even(c_acctbal / 8, 1) AS rounded
FROM customer""")
def number_helpers(spark, root):
    c = F.col
    return table(spark, root, "customer").select(
        "c_custkey", numbers.log1p_floored(c("c_acctbal")).alias("logged"),
        numbers.safe_divide(c("c_acctbal"), c("c_custkey") % 4, -1.0).alias("divided"),
        numbers.round_even(c("c_acctbal") / 8, 1).alias("rounded"))


@query("t35_t36_flags_and_least", """
SELECT id, CAST(installation_id IS NOT NULL AS INTEGER) AS installed,
  CAST(coalesce(status = 'Complete', false) AS INTEGER) AS complete,
  least(length(id), length(customer_id)) AS shorter FROM s_accounts""")
def flags(spark, root):
    return sheet(spark, root, "Accounts").select(
        "id", numbers.present(F.col("Installation_id")).alias("installed"),
        numbers.flag(F.col("status") == "Complete").alias("complete"),
        F.least(F.length("id"), F.length("customer_id")).alias("shorter"))


# --- Frames --------------------------------------------------------------------------------------

@query("p01_p04_rename_and_subset", """
SELECT id AS account_id, status AS account_status, type AS payment_type, product_id
FROM s_accounts""")
def rename(spark, root):
    renamed = frames.rename(sheet(spark, root, "Accounts"), {
        "id": "account_id", "status": "account_status", "type": "payment_type",
        "Proudct_id": "product_id"})
    return renamed.select("account_id", "account_status", "payment_type", "product_id")


@query("p02_p03_clean_headers", """
SELECT id, gender, date_of_birth, region, location, latitude, longitude, created_at
FROM s_customers""")
def headers(spark, root):
    spaced = sheet(spark, root, "Customers").withColumnsRenamed(
        {"Date_of_birth": " Date of birth ", "Latitude": "LATITUDE "})
    return frames.clean_headers(frames.clean_headers(spaced), spaces_to_underscore=False)


@query("p05_constant_columns", """
SELECT id, '' AS payment_type, 0e0 AS financed_amount, 1 AS quantity FROM s_sales""")
def constants(spark, root):
    return sheet(spark, root, "Sales").select(
        F.col("Id").alias("id"), F.lit("").alias("payment_type"),
        F.lit(0.0).alias("financed_amount"), F.lit(1).alias("quantity"))


@query("p06_drop_missing", """
SELECT id, status, installation_id FROM s_accounts
WHERE status IS NOT NULL AND installation_id IS NOT NULL""")
def drop_missing(spark, root):
    kept = frames.drop_missing(sheet(spark, root, "Accounts"), ["status", "Installation_id"])
    return kept.select("id", "status", F.col("Installation_id").alias("installation_id"))


@query("p07_fill_constant", """
SELECT id, gender, coalesce(latitude, 0) AS latitude, longitude FROM s_customers""")
def fill_constant(spark, root):
    filled = frames.fill_constant(sheet(spark, root, "Customers"), 0)
    return filled.select("id", F.col("Gender").alias("gender"),
                         F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"))


@query("p08_fill_median_age", """
SELECT customer_id, coalesce(age::DOUBLE, (SELECT quantile_cont(age, 0.5) FROM customer_table)) AS age
FROM customer_table""")
def fill_age(spark, root):
    return frames.fill_median(customer_table(spark, root).select("customer_id", "age"), "age")


_KEEP = "customer_id, country_name, payment_type, is_in_arrears, is_default"


@query("p09_p10_equality_and_flag_filters", f"""
SELECT {_KEEP} FROM customer_table WHERE lower(country_name) = 'kenya'
  AND upper(payment_type) = 'PAYG' AND is_in_arrears = 1""")
def equality(spark, root):
    rows = frames.equals_ignoring_case(customer_table(spark, root), "country_name", " KENYA")
    rows = frames.equals_ignoring_case(rows, "payment_type", "payg ")
    rows = frames.equals_flag(frames.equals_flag(rows, "is_in_arrears", True), "is_default", None)
    return rows.select(*[c.strip() for c in _KEEP.split(",")])


@query("p11_regex_filter", """
SELECT customer_id, segment_name FROM segmented
WHERE regexp_matches(coalesce(segment_name, ''), '(?i)^(early|stable).*')""")
def regex(spark, root):
    return frames.matches_pattern(segmented(spark, root), "segment_name", "^(EARLY|stable).*") \
        .select("customer_id", "segment_name")


@query("p12_p13_p14_p15_filters", """
SELECT installation_id, installation_delay_days, installation_status FROM mart_installs
WHERE installation_delay_days BETWEEN -30 AND 90
  AND (installation_status = 'Complete' OR sale_date IS NOT NULL)
  AND date_diff('day', sale_date, installation_date) >= 0
  AND installation_status IN ('Complete', 'Advance')""")
def filters(spark, root):
    mart = warehouse(spark, root)["mart_installation_operations"]
    return mart.where(F.col("installation_delay_days").between(-30, 90)) \
        .where((F.col("installation_status") == "Complete") | F.col("sale_date").isNotNull()) \
        .where(dates.calendar_days(F.col("installation_date"), F.col("sale_date")) >= 0) \
        .where(F.col("installation_status").isin(["Complete", "Advance"])) \
        .select("installation_id", "installation_delay_days", "installation_status")


@query("p16_keep_existing", "SELECT customer_id, payment_type FROM customer_table")
def keep_existing(spark, root):
    return frames.keep_existing(customer_table(spark, root),
                                ["customer_id", "no_such_column", "payment_type"])


@query("p17_eligible_segments", """
SELECT segment_id, segment_name FROM (SELECT segment_id, segment_name, avg(is_in_arrears) AS a,
  avg(is_default) AS b, avg(repayment_progress) AS c FROM segmented WHERE segment_id IS NOT NULL
  AND lower(country_name) = 'kenya' GROUP BY 1, 2)
WHERE NOT (a <= 0.15e0 AND b <= 0.1e0 AND c >= 0.55e0)""")
def not_eligible(spark, root):
    from ledgerfield.plans.campaigns import campaign_scores, is_eligible

    scores = campaign_scores(segmented(spark, root), "Kenya")
    return scores.where(~is_eligible()).select("segment_id", "segment_name")


@query("p18_valid_uuid", f"""
SELECT id, mixed FROM (SELECT id, CASE WHEN length(id) % 2 = 0 THEN {key('id')} ELSE id END AS mixed
  FROM s_customers) WHERE mixed LIKE '%-%-%-%-%'""")
def valid_uuid(spark, root):
    mixed = F.when(F.length("id") % 2 == 0, keys.surrogate_key(F.col("id"))).otherwise(F.col("id"))
    return frames.keep_valid_uuid(
        sheet(spark, root, "Customers").select("id", mixed.alias("mixed")), "mixed")
