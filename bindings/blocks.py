"""Registered joins, aggregates, windows, ordering and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.columns import sheet, table
from bindings.registry import query
from bindings.reports import customer_table, segmented
from bindings.sheets import warehouse
from ledgerfield.operators import aggregates, describe, joins, ordering, quality, quantiles
from ledgerfield.plans.features import segmentation_features
from ledgerfield.plans.profiles import name_segments, profile_segments, segment_lifts


# --- Joins ---------------------------------------------------------------------------------------

@query("j01_left_join_same_key", """
SELECT s.id AS sale_id, s.account_id, a.status FROM s_sales s LEFT JOIN s_accounts a
  ON s.account_id = a.id""")
def left_same(spark, root):
    accounts = sheet(spark, root, "Accounts").select(F.col("id").alias("account_id"), "status")
    return sheet(spark, root, "Sales").select(F.col("Id").alias("sale_id"), "account_id") \
        .join(accounts, "account_id", "left")


@query("j02_left_join_other_key", """
SELECT a.id AS account_id, a.installation_id, i.engineer_id FROM s_accounts a
LEFT JOIN s_installations i ON a.installation_id = i.id""")
def left_other(spark, root):
    accounts = sheet(spark, root, "Accounts").select(
        F.col("id").alias("account_id"), F.col("Installation_id").alias("installation_id"))
    installations = sheet(spark, root, "Installations").select("Id", "engineer_id")
    return joins.left_lookup(accounts, installations, [("installation_id", "Id")], "account_id")


@query("j03_left_join_composite_key", """
SELECT a.id AS account_id, l.source FROM s_accounts a LEFT JOIN s_leads l
  ON a.lead_id = l.id AND a.customer_id = l.customer_id""")
def left_composite(spark, root):
    accounts = sheet(spark, root, "Accounts").select(
        F.col("id").alias("account_id"), "lead_id", "customer_id")
    leads = sheet(spark, root, "Leads").select(
        F.col("Id").alias("l_id"), F.col("customer_id").alias("l_customer"),
        F.col("Source").alias("source"))
    return joins.left_lookup(accounts, leads, [("lead_id", "l_id"), ("customer_id", "l_customer")],
                             "account_id").select("account_id", "source")


@query("j04_full_outer_join", """
SELECT coalesce(s.account_id, a.id) AS account_id, s.id AS sale_id, a.status
FROM s_sales s FULL OUTER JOIN s_accounts a ON s.account_id = a.id""")
def outer(spark, root):
    sales = sheet(spark, root, "Sales").select("account_id", F.col("Id").alias("sale_id"))
    accounts = sheet(spark, root, "Accounts").select(F.col("id").alias("account_id"), "status")
    return joins.full_outer(sales, accounts, ["account_id"])


@query("j05_inner_join", """
SELECT s.id AS sale_id, a.id AS account_id FROM s_sales s JOIN s_accounts a ON s.account_id = a.id""")
def inner(spark, root):
    sales = sheet(spark, root, "Sales").select(F.col("Id").alias("sale_id"), "account_id")
    accounts = sheet(spark, root, "Accounts").select(F.col("id").alias("account_id"))
    return sales.join(accounts, "account_id")


@query("j06_j07_star_and_snowflake", """
SELECT installation_id, country_name, product_name, installer_name, installer_department
FROM mart_installs""")
def snowflake(spark, root):
    return warehouse(spark, root).plan("mart_installation_operations").select(
        "installation_id", "country_name", "product_name", "installer_name",
        "installer_department")


@query("j08_lookup_with_type_defaults", """
SELECT a.id AS account_id, coalesce(p.product, '') AS product_name,
  coalesce(p.is_refurb, false) AS is_refurb
FROM s_accounts a LEFT JOIN s_products p ON a.product_id = p.id""")
def dictionary(spark, root):
    accounts = sheet(spark, root, "Accounts").select(F.col("id").alias("account_id"), "Proudct_id")
    products = sheet(spark, root, "Products").select(
        "Id", F.col("Product").alias("product_name"), "is_refurb")
    return joins.lookup_or_default(accounts, products, [("Proudct_id", "Id")],
                                   {"product_name": "", "is_refurb": False}).drop("Proudct_id")


@query("j09_name_lookup", """
SELECT l_suppkey, lines, coalesce(s_name, 'Unknown') AS supplier FROM (
  SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY 1)
LEFT JOIN (SELECT CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS k, s_name FROM supplier)
  ON l_suppkey = k""")
def names(spark, root):
    lines = aggregates.count_by(table(spark, root, "lineitem"), ["l_suppkey"], "lines")
    suppliers = table(spark, root, "supplier").select(
        F.expr("CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END").alias("s_suppkey"), F.col("s_name").alias("supplier"))
    return joins.lookup_or_default(lines, suppliers, [("l_suppkey", "s_suppkey")],
                                   {"supplier": "Unknown"})


@query("j10_j11_j12_anti_joins", """
SELECT 'leads without account' AS side, count(*) AS n FROM s_leads
  WHERE NOT EXISTS (SELECT 1 FROM s_accounts WHERE lead_id = s_leads.id)
UNION ALL SELECT 'accounts without sale', count(*) FROM s_accounts
  WHERE NOT EXISTS (SELECT 1 FROM s_sales WHERE account_id = s_accounts.id)
UNION ALL SELECT 'sales without account', count(*) FROM s_sales
  WHERE NOT EXISTS (SELECT 1 FROM s_accounts WHERE id = s_sales.account_id)
UNION ALL SELECT 'accounts without lead', count(*) FROM s_accounts
  WHERE NOT EXISTS (SELECT 1 FROM s_leads WHERE id = s_accounts.lead_id)""")
def anti(spark, root):
    leads, accounts, sales = (sheet(spark, root, n) for n in ("Leads", "Accounts", "Sales"))
    sides = [
        ("leads without account", joins.without_match(leads, accounts, "Id", "lead_id")),
        ("accounts without sale", joins.without_match(accounts, sales, "id", "account_id")),
        ("sales without account", joins.without_match(sales, accounts, "account_id", "id")),
        ("accounts without lead", joins.without_match(accounts, leads, "lead_id", "Id")),
    ]
    out = None
    for name, df in sides:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("j13_membership_flag", """
SELECT id, CAST(EXISTS (SELECT 1 FROM s_accounts WHERE lead_id = s_leads.id) AS INTEGER)
  AS converted FROM s_leads""")
def membership(spark, root):
    leads = sheet(spark, root, "Leads").select(F.col("Id").alias("id"))
    return joins.flag_members(leads, sheet(spark, root, "Accounts"), "id", "lead_id", "converted")


@query("j14_o06_one_row_per_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def one_per_key(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_suppkey")
    return joins.one_per_key(lines, "l_orderkey", ["l_linenumber", "l_partkey"])


@query("j15_w04_group_value_on_rows", """
SELECT o_orderkey, o_orderpriority, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS mean_price
FROM orders""")
def group_value(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    means = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean_price"))
    return joins.attach_group_values(orders, means, "o_orderpriority").drop("o_totalprice")


@query("j16_lead_creation_by_id", """
SELECT a.id AS account_id, l.created_at AS lead_created FROM s_accounts a
LEFT JOIN s_leads l ON a.lead_id = l.id""")
def lead_creation(spark, root):
    accounts = sheet(spark, root, "Accounts").select(F.col("id").alias("account_id"), "lead_id")
    leads = sheet(spark, root, "Leads").select("Id", F.col("created_at").alias("lead_created"))
    return joins.left_lookup(accounts, leads, [("lead_id", "Id")], "account_id").drop("lead_id")


# --- Aggregates ----------------------------------------------------------------------------------

@query("a01_count_by_region", "SELECT region, count(*) AS count FROM s_customers GROUP BY 1")
def count_by(spark, root):
    return aggregates.count_by(sheet(spark, root, "Customers"), ["region"])


@query("a02_a03_global_and_group_aggregates", """
SELECT l_returnflag, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price,
  min(l_discount) AS min_discount, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', sum(l_quantity), avg(l_extendedprice), min(l_discount), max(l_tax), count(*)
FROM lineitem""")
def sums(spark, root):
    lines = table(spark, root, "lineitem")
    parts = [F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"),
             F.min("l_discount").alias("min_discount"), F.max("l_tax").alias("max_tax"),
             F.count("*").alias("n")]
    total = lines.agg(*parts).withColumn("l_returnflag", F.lit("all"))
    return lines.groupBy("l_returnflag").agg(*parts).unionByName(total)


@query("a04_a05_exact_quantiles", " UNION ALL ".join(f"""
SELECT l_returnflag, '{c}' AS metric, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75,
  quantile_cont({c}, 0.999) AS q99_9 FROM lineitem GROUP BY 1"""
    for c in ("l_extendedprice", "l_quantity", "l_discount")))
def exact_quantiles(spark, root):
    return quantiles.exact_quantiles(
        table(spark, root, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"],
        [0.5, 0.75, 0.999], ["l_returnflag"])


@query("a06_a07_conditional_aggregates", """
SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS large,
  avg(o_totalprice) FILTER (o_totalprice > 1e9) AS none,
  avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1""")
def conditional(spark, root):
    price = F.col("o_totalprice")
    return table(spark, root, "orders").groupBy("o_orderstatus").agg(
        F.count_if(price > 200000).alias("large"),
        F.avg(F.when(price > 1e9, price)).alias("none"),
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", price)).alias("urgent"))


@query("a08_distinct_counts", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts
FROM lineitem GROUP BY 1""")
def distinct_counts(spark, root):
    lines = table(spark, root, "lineitem").select(
        "l_returnflag", F.col("l_orderkey").alias("orders"), F.col("l_partkey").alias("parts"))
    return aggregates.distinct_counts(lines, ["l_returnflag"], ["orders", "parts"])


@query("a08_distinct_counts_of_text_and_numbers", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_shipdate) AS days,
  count(DISTINCT l_extendedprice) AS prices, count(DISTINCT l_linestatus) AS states
FROM lineitem GROUP BY 1""")
def distinct_counts_of_all_kinds(spark, root):
    lines = table(spark, root, "lineitem").select(
        "l_returnflag", F.col("l_orderkey").alias("orders"), F.col("l_shipdate").alias("days"),
        F.col("l_extendedprice").alias("prices"), F.col("l_linestatus").alias("states"))
    return aggregates.distinct_counts(lines, ["l_returnflag"], ["orders", "days", "prices", "states"])


@query("a09_distinct_values", "SELECT DISTINCT source FROM s_leads WHERE source IS NOT NULL")
def distinct_values(spark, root):
    return sheet(spark, root, "Leads").select(F.col("Source").alias("source")).na.drop().distinct()


@query("a10_distinct_combinations", """
SELECT region, location, count(*) AS count FROM s_customers
WHERE region IS NOT NULL AND location IS NOT NULL GROUP BY 1, 2""")
def combinations(spark, root):
    customers = sheet(spark, root, "Customers").withColumnRenamed("Location", "location")
    return aggregates.distinct_combinations(customers, ["region", "location"])


@query("a11_a12_a13_first_mode_weighted", """
SELECT c.customer_id, arg_min(lead_source, account_id) FILTER (lead_source IS NOT NULL) AS first_source,
  any_value(m.v) AS payment_type,
  sum(repayment_progress * CASE outstanding_balance WHEN 0 THEN 1 ELSE outstanding_balance END)
    / sum(CASE outstanding_balance WHEN 0 THEN 1 ELSE outstanding_balance END) AS progress
FROM account_table c LEFT JOIN (SELECT id, v FROM (SELECT customer_id AS id, payment_type AS v,
    row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, payment_type) AS rn
  FROM account_table GROUP BY 1, 2) WHERE rn = 1) m ON m.id = c.customer_id GROUP BY 1""")
def first_mode_weighted(spark, root):
    accounts = warehouse(spark, root)["account_table"]
    modes = aggregates.modes_by(accounts, ["customer_id"], {"payment_type": "PAYG"})
    each = accounts.groupBy("customer_id").agg(
        aggregates.first_present("lead_source", F.col("account_id")).alias("first_source"),
        aggregates.weighted_mean("repayment_progress", "outstanding_balance").alias("progress"))
    return each.join(modes, each["customer_id"].eqNullSafe(modes["customer_id"])).drop(modes["customer_id"])


@query("a12_modes_of_hot_groups", """
SELECT l_returnflag, any_value(k) FILTER (m = 'price') AS price, any_value(k) FILTER (m = 'day') AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, m ORDER BY n DESC, k) AS place FROM (
    SELECT l_returnflag, m, k, count(*) AS n FROM (
      SELECT l_returnflag, 'price' AS m, CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) AS k FROM lineitem
      UNION ALL SELECT l_returnflag, 'day', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)
    GROUP BY 1, 2, 3)) WHERE place = 1 GROUP BY 1""")
def modes_of_hot_groups(spark, root):
    lines = table(spark, root, "lineitem").select(
        "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return aggregates.modes_by(lines, ["l_returnflag"], {"price": None, "day": None})


@query("a25_medians_of_hot_groups", """
SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.5) AS price,
  quantile_cont(l_partkey, 0.5) AS part FROM lineitem GROUP BY 1, 2""")
def medians_of_hot_groups(spark, root):
    lines = table(spark, root, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"))
    return quantiles.medians_by(lines, ["l_returnflag", "l_linestatus"], ["price", "part"])


@query("a14_a25_aggregate_by_spec", """
SELECT country_name, payment_type, avg(financed_amount) AS financed_amount,
  max(days_past_due) AS days_past_due, quantile_cont(account_age_days, 0.5) AS account_age_days,
  count(DISTINCT customer_id) AS customer_id FROM account_table
WHERE country_name IS NOT NULL AND payment_type IS NOT NULL GROUP BY 1, 2""")
def by_spec(spark, root):
    return aggregates.aggregate_spec(
        warehouse(spark, root)["account_table"], ["country_name", "payment_type"],
        {"financed_amount": "mean", "days_past_due": "max", "account_age_days": "median",
         "customer_id": "nunique"})


_METRICS = ["age", "account_age_days", "financed_amount", "outstanding_balance",
            "repayment_progress", "arrears_rate", "days_past_due", "is_in_arrears", "is_default",
            "risk_stress_score", "lead_conversion_speed", "installation_delay_days"]


@query("a15_segment_profile", f"""
SELECT segment_id, {', '.join(
    f"avg({c}) AS {c}_mean, quantile_cont({c}, 0.5) AS {c}_median, count({c}) AS {c}_count"
    for c in _METRICS)}, count(*) AS customer_count,
  round_even(count(*) * 100e0 / (SELECT count(*) FROM segmented), 1) AS pct_of_customers
FROM segmented WHERE segment_id IS NOT NULL GROUP BY 1""")
def profile(spark, root):
    return profile_segments(segmented(spark, root))


_LIFTS = f"""(SELECT segment_id, count(*) AS size, {', '.join(
    f"avg({c}) AS {c}_mean, CASE WHEN any_value(g.{c}_all) = 0 THEN 0 ELSE "
    f"avg({c}) / any_value(g.{c}_all) - 1 END AS {c}_lift" for c in _METRICS)}
FROM segmented CROSS JOIN (SELECT {', '.join(f'avg({c}) AS {c}_all' for c in _METRICS)}
  FROM segmented) g WHERE segment_id IS NOT NULL GROUP BY 1)"""


@query("a16_segment_lifts", f"SELECT * FROM {_LIFTS}")
def lifts(spark, root):
    return segment_lifts(segmented(spark, root))


@query("t37_segment_names", f"""
SELECT segment_id, CASE WHEN is_default_mean > 0.35 THEN 'Distressed Defaulters'
  WHEN is_in_arrears_mean > 0.4 THEN 'Arrears-Stressed PAYG'
  WHEN repayment_progress_mean > 0.65 AND financed_amount_mean
    >= (SELECT quantile_cont(financed_amount_mean, 0.5) FROM {_LIFTS}) THEN 'Stable Premium Growers'
  WHEN repayment_progress_mean > 0.55 THEN 'Reliable Mid-Tier' ELSE 'Early-Tenure Builders' END
  AS segment_name FROM {_LIFTS}""")
def segment_names(spark, root):
    return name_segments(segment_lifts(segmented(spark, root)))


@query("a17_a18_a19_a20_rates_shares_extremes", """
SELECT max(lead_source) FILTER (hi = 1) AS worst, max(lead_source) FILTER (lo = 1) AS best,
  count(*) AS sources FROM (
  SELECT lead_source, row_number() OVER (ORDER BY r DESC, lead_source) AS hi,
    row_number() OVER (ORDER BY r, lead_source) AS lo FROM (
    SELECT lead_source, avg(CAST(payment_type = 'PAYG' AS INTEGER)) AS r, count(*) AS n
    FROM account_table WHERE lead_source IS NOT NULL GROUP BY 1 HAVING count(*) >= 30))""")
def extremes(spark, root):
    sources = warehouse(spark, root)["account_table"].na.drop(subset=["lead_source"]) \
        .groupBy("lead_source").agg(
            aggregates.share_of("payment_type", "PAYG").alias("r"), F.count("*").alias("n")) \
        .where("n >= 30")
    return sources.agg(
        F.min_by("lead_source", F.struct(-F.col("r"), F.col("lead_source"))).alias("worst"),
        F.min_by("lead_source", F.struct("r", "lead_source")).alias("best"),
        F.count("*").alias("sources"))


@query("a17_rates_by_tier", """
SELECT product_tier, count(customer_id) AS customers, round_even(avg(is_in_arrears) * 100, 2) AS arrears_pct,
  round_even(avg(is_default) * 100, 2) AS default_pct FROM customer_table GROUP BY 1""")
def rates_by_tier(spark, root):
    return aggregates.rates_by(customer_table(spark, root), ["product_tier"],
                               arrears_pct="is_in_arrears", default_pct="is_default")


@query("a21_a22_pivot", """
SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS "O",
  sum(l_quantity) FILTER (l_linestatus = 'F') AS "F", 0e0 AS "X" FROM lineitem GROUP BY 1""")
def pivot(spark, root):
    return aggregates.pivot_values(table(spark, root, "lineitem"), "l_returnflag", "l_linestatus",
                                   ["O", "F", "X"], F.sum("l_quantity"), 0.0)


@query("a23_cohort_counts", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS cohort_month, o_orderstatus,
  count(*) AS count FROM orders GROUP BY 1, 2""")
def cohorts(spark, root):
    return aggregates.cohort_counts(table(spark, root, "orders"), "o_orderstatus", "o_orderdate")


@query("a24_business_metrics", """
SELECT 'total_customers' AS metric, count(DISTINCT o_custkey)::DOUBLE AS value FROM orders
UNION ALL SELECT 'average_order_value', avg(o_totalprice) FROM orders""")
def business_metrics(spark, root):
    orders = table(spark, root, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("order_value"))
    return aggregates.business_metrics(orders)


@query("a26_mean_of_numeric_columns", """
SELECT l_returnflag, l_linestatus, avg(l_quantity) AS l_quantity,
  avg(l_extendedprice) AS l_extendedprice, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax
FROM lineitem GROUP BY 1, 2""")
def mean_by(spark, root):
    lines = table(spark, root, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return aggregates.mean_by(lines, ["l_returnflag", "l_linestatus"])


@query("a27_value_counts_per_segment", """
SELECT segment_id, product_tier AS value, count(*) AS customers FROM segmented
WHERE segment_id IS NOT NULL GROUP BY 1, 2""")
def value_counts(spark, root):
    from ledgerfield.plans.campaigns import segment_value_counts

    return segment_value_counts(segmented(spark, root), "product_tier")


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a28_describe", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
  min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
  quantile_cont({c}, 0.75) AS q75, max({c}) AS max, count(*) FILTER ({c} IS NULL) AS nulls
FROM lineitem""" for c in _NUMBERS))
def describe_numbers(spark, root):
    return describe.describe_numeric(table(spark, root, "lineitem"), _NUMBERS)


@query("a28_null_counts_and_types", """
SELECT column_name AS "column", CASE data_type WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type,
  nulls FROM (VALUES ('id', 'VARCHAR'), ('Gender', 'VARCHAR'), ('region', 'VARCHAR'),
    ('Latitude', 'DOUBLE')) t(column_name, data_type)
JOIN (SELECT 'id' AS c, count(*) FILTER (id IS NULL) AS nulls FROM s_customers
  UNION ALL SELECT 'Gender', count(*) FILTER (gender IS NULL) FROM s_customers
  UNION ALL SELECT 'region', count(*) FILTER (region IS NULL) FROM s_customers
  UNION ALL SELECT 'Latitude', count(*) FILTER (latitude IS NULL) FROM s_customers)
  ON c = column_name""")
def nulls_and_types(spark, root):
    customers = sheet(spark, root, "Customers").select("id", "Gender", "region", "Latitude")
    return quality.null_counts(customers, customers.columns).join(
        describe.column_types(customers), "column")


@query("a29_correlations", " UNION ALL ".join(f"""
SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM lineitem"""
    for a in _NUMBERS for b in _NUMBERS))
def correlations(spark, root):
    return describe.correlations(table(spark, root, "lineitem"), _NUMBERS)


_MANY = [f"{c}_{k}" for c in _NUMBERS for k in range(25)]


@query("a29_correlations_of_wide_frames", f"""
WITH wide AS (SELECT {', '.join(
    f"CASE WHEN l_orderkey % {k + 2} <> 1 THEN ({c} + {k} * (l_suppkey % 7))::DOUBLE END AS {c}_{k}"
    for c in _NUMBERS for k in range(25))} FROM lineitem)
""" + " UNION ALL ".join(f"""
SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM wide"""
    for a in _MANY[:6] for b in _MANY[::7]))
def wide_correlations(spark, root):
    """A hundred columns with nulls in different rows; SQL for some of the pairs."""
    wide = table(spark, root, "lineitem").select(*[
        F.when(F.col("l_orderkey") % (k + 2) != 1, F.col(c).cast("double") + k * (F.col("l_suppkey") % 7))
        .alias(f"{c}_{k}") for c in _NUMBERS for k in range(25)])
    return describe.correlations(wide, _MANY).where(
        F.col("column_a").isin(_MANY[:6]) & F.col("column_b").isin(_MANY[::7]))


@query("a30_distribution", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std,
  min({c}) AS min, max({c}) AS max FROM lineitem""" for c in _NUMBERS))
def distribution(spark, root):
    return describe.distribution(table(spark, root, "lineitem"), _NUMBERS)


@query("a31_histogram", """
SELECT bin, count(*) AS count, min(low) AS low, min(high) AS high FROM (
  SELECT low, high, CAST(least(floor((o_totalprice - low) * 20 / (high - low)) + 1, 20) AS INTEGER) AS bin
  FROM orders CROSS JOIN (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders))
GROUP BY 1""")
def histogram(spark, root):
    return describe.histogram(table(spark, root, "orders"), "o_totalprice", 20)


@query("a32_min_cluster_share", """
SELECT min(n) * 100e0 / sum(n) AS min_cluster_pct FROM (
  SELECT label, count(*) AS n FROM embeddings GROUP BY 1)""")
def min_share(spark, root):
    sizes = aggregates.count_by(table(spark, root, "embeddings"), ["label"], "n")
    return sizes.agg((F.min("n") * 100.0 / F.sum("n")).alias("min_cluster_pct"))


@query("a33_normalised_by_maximum", """
SELECT segment_id, n / max(n) OVER () AS size_score FROM (
  SELECT segment_id, count(*) AS n FROM segmented WHERE segment_id IS NOT NULL GROUP BY 1)""")
def normalised(spark, root):
    from ledgerfield.plans.campaigns import campaign_scores

    return campaign_scores(segmented(spark, root), "Atlantis").select("segment_id", "size_score")


@query("a34_missing_summary", """
SELECT 'customer_id' AS "column", count(*) FILTER (customer_id IS NULL) AS nulls,
  count(*) FILTER (customer_id = '') AS empties, 0 AS zeros FROM fact_lead_funnel
UNION ALL SELECT 'days_to_sale', count(*) FILTER (days_to_sale IS NULL), 0,
  count(*) FILTER (days_to_sale = 0) FROM fact_lead_funnel""")
def missing(spark, root):
    return describe.missing_summary(warehouse(spark, root)["fact_lead_funnel"],
                                    ["customer_id", "days_to_sale"])


# --- Windows and order ---------------------------------------------------------------------------

_MONTHS = """(SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, count(*) AS n
  FROM orders GROUP BY 1, 2)"""


def _months(spark, root):
    from ledgerfield.functions.dates import month_start

    return aggregates.count_by(
        table(spark, root, "orders").withColumn("month", month_start(F.col("o_orderdate"))),
        ["o_orderstatus", "month"], "n")


@query("w01_percent_change", f"""
SELECT o_orderstatus, strftime(month, '%Y-%m-%d') AS month, n, (n - p) * 100e0 / p AS change FROM (
  SELECT *, lag(n) OVER (PARTITION BY o_orderstatus ORDER BY month) AS p FROM {_MONTHS})
WHERE p IS NOT NULL""")
def percent_change(spark, root):
    return ordering.percent_change(_months(spark, root), "o_orderstatus", ["month"], "n", "change")


@query("w02_percent_change_down_table", f"""
SELECT month, "F", "O", ("F" - lag("F") OVER w) * 100e0 / nullif(lag("F") OVER w, 0) AS "F_growth_pct",
  ("O" - lag("O") OVER w) * 100e0 / nullif(lag("O") OVER w, 0) AS "O_growth_pct" FROM (
  SELECT strftime(month, '%Y-%m-%d') AS month,
    CAST(coalesce(sum(n) FILTER (o_orderstatus = 'F'), 0) AS BIGINT) AS "F",
    CAST(coalesce(sum(n) FILTER (o_orderstatus = 'O'), 0) AS BIGINT) AS "O" FROM {_MONTHS} GROUP BY 1)
WINDOW w AS (ORDER BY month)""")
def change_down(spark, root):
    wide = aggregates.pivot_values(_months(spark, root), "month", "o_orderstatus", ["F", "O"],
                                   F.sum("n"), 0, others="rest").drop("rest")
    return ordering.percent_change_down(wide, "month", ["F", "O"])


@query("w03_rolling_mean", f"""
SELECT o_orderstatus, strftime(month, '%Y-%m-%d') AS month, n, avg(n) OVER (
  PARTITION BY o_orderstatus ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean
FROM {_MONTHS}""")
def rolling(spark, root):
    return ordering.rolling_mean(_months(spark, root), "o_orderstatus", "month", "n", 3, "mean")


@query("w05_average_percent_rank", """
SELECT l_orderkey, l_linenumber, l_partkey, l_discount, (rank() OVER (ORDER BY l_discount)
  + (count(*) OVER (PARTITION BY l_discount) - 1) / 2e0) / count(*) OVER () AS pct FROM lineitem""")
def percent_rank(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_discount")
    return quantiles.percent_rank_average(lines, "l_discount", "pct")


@query("w05_average_percent_rank_prices", """
SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice)
  + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2e0) / count(*) OVER () AS pct FROM orders""")
def percent_rank_prices(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_totalprice")
    return quantiles.percent_rank_average(orders, "o_totalprice", "pct").drop("o_totalprice")


@query("w06_w07_w11_recency_frequency_fill", """
SELECT customer_id, recency_score, frequency_score, lead_conversion_speed, installation_delay_days,
  install_delay_flag, monetary_score, lead_quality_score FROM customer_table""")
def behavioural(spark, root):
    from ledgerfield.plans.features import add_behavioral_features

    base = warehouse(spark, root)["customer_aggregate"]
    return add_behavioral_features(base).select(
        "customer_id", "recency_score", "frequency_score", "lead_conversion_speed",
        "installation_delay_days", "install_delay_flag", "monetary_score", "lead_quality_score")


@query("w08_days_since_first", """
SELECT o_orderkey, o_custkey, CAST(date_diff('day', min(o_orderdate) OVER (PARTITION BY o_custkey),
  o_orderdate) AS INTEGER) AS age_days FROM orders""")
def since_first(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ordering.days_since_first(orders, "o_custkey", "o_orderdate", "age_days") \
        .drop("o_orderdate")


@query("w10_top_per_group", """
SELECT o_orderstatus, o_custkey, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT o_orderstatus, o_custkey, count(*) AS n,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_custkey) AS rank
  FROM orders GROUP BY 1, 2) WHERE rank <= 3""")
def top(spark, root):
    counts = aggregates.count_by(table(spark, root, "orders"), ["o_orderstatus", "o_custkey"], "n")
    return ordering.top_per_group(counts, ["o_orderstatus"], [F.col("n").desc(), F.col("o_custkey")],
                                  3)


@query("o01_o02_sort_and_limit", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def sort_limit(spark, root):
    orders = table(spark, root, "orders").select(
        "o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down"))
    return ordering.sample_rows(orders, ["down", "o_orderkey"], 1000).drop("down")


@query("o03_o04_o05_two_best_and_rest", """
SELECT segment_id, 'chosen' AS side FROM (SELECT segment_id, avg(repayment_progress) AS s
  FROM segmented WHERE segment_id IS NOT NULL GROUP BY 1 ORDER BY s DESC, segment_id LIMIT 2)
UNION ALL SELECT segment_id, 'rest' FROM (SELECT segment_id,
  row_number() OVER (ORDER BY avg(repayment_progress) DESC, segment_id) AS rn
  FROM segmented WHERE segment_id IS NOT NULL GROUP BY 1) WHERE rn > 2""")
def best_and_rest(spark, root):
    scores = segmented(spark, root).na.drop(subset=["segment_id"]).groupBy("segment_id").agg(
        F.avg("repayment_progress").alias("s"))
    chosen = ordering.top_two_with_filler(scores, F.lit(True), "s", "segment_id") \
        .select("segment_id")
    rest = joins.exclude_chosen(scores, chosen, "segment_id").select("segment_id")
    return chosen.withColumn("side", F.lit("chosen")).unionByName(
        rest.withColumn("side", F.lit("rest")))


# --- Checks --------------------------------------------------------------------------------------

@query("v02_null_counts", """
SELECT 'status' AS "column", count(*) FILTER (status IS NULL) AS nulls FROM s_accounts
UNION ALL SELECT 'Installation_id', count(*) FILTER (installation_id IS NULL) FROM s_accounts
UNION ALL SELECT 'id', count(*) FILTER (id IS NULL) FROM s_accounts""")
def null_counts(spark, root):
    return quality.null_counts(sheet(spark, root, "Accounts"), ["status", "Installation_id", "id"])


def funnel_checks() -> list[quality.Check]:
    stages = ["converted_to_account", "converted_to_sale", "converted_to_installation"]
    days = ["days_to_account", "days_to_sale", "days_to_installation"]
    return [
        quality.not_null("lead_id"), quality.unique("lead_id"),
        quality.not_null("lead_created_date"), quality.not_empty_text("customer_id"),
        *[quality.in_values(c, [0, 1]) for c in stages],
        quality.in_range("lead_quality_score", 0.0, 1.0),
        *[quality.not_negative(c) for c in days],
    ]


@query("v03_v04_o07_funnel_checks", """
SELECT c AS "check", s AS severity, CAST(v AS BIGINT) AS violations, v = 0 AS passed FROM (
  SELECT 'lead_id has no nulls' AS c, 'error' AS s, count(*) FILTER (lead_id IS NULL) AS v
    FROM fact_lead_funnel_numeric
  UNION ALL SELECT 'lead_id is unique', 'error', count(*) - count(DISTINCT lead_id)
    FROM fact_lead_funnel_numeric
  UNION ALL SELECT 'lead_created_date has no nulls', 'error',
    count(*) FILTER (lead_created_date IS NULL) FROM fact_lead_funnel_numeric
  UNION ALL SELECT 'customer_id is not empty', 'warn', count(*) FILTER (customer_id = '')
    FROM fact_lead_funnel_numeric
  UNION ALL SELECT 'converted_to_account in [0, 1]', 'error', 0
  UNION ALL SELECT 'converted_to_sale in [0, 1]', 'error', 0
  UNION ALL SELECT 'converted_to_installation in [0, 1]', 'error', 0
  UNION ALL SELECT 'lead_quality_score between 0 and 1', 'error',
    count(*) FILTER (NOT coalesce(lead_quality_score BETWEEN 0 AND 1, false))
    FROM fact_lead_funnel_numeric
  UNION ALL SELECT 'days_to_account is not negative', 'error',
    count(*) FILTER (days_to_account < 0) FROM fact_lead_funnel_numeric
  UNION ALL SELECT 'days_to_sale is not negative', 'error',
    count(*) FILTER (days_to_sale < 0) FROM fact_lead_funnel_numeric
  UNION ALL SELECT 'days_to_installation is not negative', 'error',
    count(*) FILTER (days_to_installation < 0) FROM fact_lead_funnel_numeric)""")
def checks(spark, root):
    return quality.run_checks(warehouse(spark, root)["fact_lead_funnel_numeric"], funnel_checks())


@query("u01_u02_native_row_and_group_functions", """
SELECT lead_id, days_to_account, days_to_sale, days_to_installation,
  round(lead_quality_score::DOUBLE, 6) AS lead_quality_score FROM fact_lead_funnel_numeric""")
def native_functions(spark, root):
    return warehouse(spark, root).plan("fact_lead_funnel_numeric").select(
        "lead_id", "days_to_account", "days_to_sale", "days_to_installation",
        "lead_quality_score")


@query("m01_customer_features", """
SELECT customer_id, customer_age_group, tenure_bucket FROM customer_table""")
def customer_features(spark, root):
    from ledgerfield.plans.features import add_customer_features

    return add_customer_features(warehouse(spark, root)["customer_aggregate"]).select(
        "customer_id", "customer_age_group", "tenure_bucket")


@query("m02_risk_features", """
SELECT customer_id, outstanding_to_financed, arrears_rate, days_past_due_cap, risk_stress_score
FROM customer_table""")
def risk_features(spark, root):
    from ledgerfield.plans.features import add_risk_features

    return add_risk_features(warehouse(spark, root)["customer_aggregate"]).select(
        "customer_id", "outstanding_to_financed", "arrears_rate", "days_past_due_cap",
        "risk_stress_score")


@query("m03_behavioral_features", """
SELECT customer_id, lead_conversion_speed, install_delay_flag, lead_quality_score, monetary_score
FROM customer_table""")
def behavioral_features(spark, root):
    from ledgerfield.plans.features import add_behavioral_features

    return add_behavioral_features(warehouse(spark, root)["customer_aggregate"]).select(
        "customer_id", "lead_conversion_speed", "install_delay_flag", "lead_quality_score",
        "monetary_score")


@query("m04_segmentation_features", """
SELECT customer_id, ln(1 + greatest(financed_amount, 0)) AS financed_amount_log,
  CASE product_tier WHEN 'New' THEN 3 WHEN 'Refurbished' THEN 1 ELSE 2 END AS product_tier_ord,
  CAST(payment_type = 'PAYG' AS INTEGER) AS payment_type_enc,
  coalesce(gender, 'Unknown') AS gender, coalesce(lead_source, 'Unknown') AS lead_source,
  'Unknown' AS age_bucket, 0e0 AS monetary_score, 0 AS install_delay_flag FROM customer_table""")
def features(spark, root):
    reduced = customer_table(spark, root).drop("age_bucket", "monetary_score",
                                               "install_delay_flag")
    return segmentation_features(reduced).select(
        "customer_id", "financed_amount_log", "product_tier_ord", "payment_type_enc", "gender",
        "lead_source", "age_bucket", "monetary_score", "install_delay_flag")


