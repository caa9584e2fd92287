"""Registered readers, sinks, catalog and audit helpers. Files go to the shared scratch folder."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from bindings.blocks import funnel_checks
from bindings.columns import sheet, table
from bindings.registry import d, query
from bindings.reports import customer_table, segment_labels, segmented
from bindings.sheets import REFERENCE_DATE, warehouse
from ledgerfield.constants import SHEETS
from ledgerfield.operators import ordering
from ledgerfield.operators.quality import ValidationError, require_columns, run_checks
from ledgerfield.plans.customers import with_segments
from ledgerfield.plans.warehouse import Warehouse
from ledgerfield.sources import audit, catalog, readers, sinks
from ledgerfield.sources.scratch import scratch_path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def scratch(spark, root: str, name: str) -> str:
    return scratch_path(spark, "queries", root.strip("/").replace("/", "_"), name)


def view(spark, root: str, name: str, df) -> str:
    """A temporary view named after the data folder."""
    full = f"{name}_{root.strip('/').replace('/', '_').replace('.', '_')}"
    df.createOrReplaceTempView(full)
    return full


def own_name(spark, root: str, name: str) -> str:
    """A catalog name of this application and data folder."""
    words = f"{spark.sparkContext.applicationId}_{root.strip('/')}"
    return f"ledgerfield_{name}_" + "".join(c if c.isalnum() else "_" for c in words).lower()


def drop_table(spark, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- Sources -------------------------------------------------------------------------------------

def _count(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}"
                              for n in names)


def _exported(spark, root: str, names: list[str]) -> str:
    """Folder with a file export of every named sheet; the warehouse itself reads most where they lie."""
    path = scratch(spark, root, "sheets")
    for name in names:
        sinks.write_parquet(sheet(spark, root, name), f"{path}/{name}")
    return path


@query("s01_read_all_sheets", """
SELECT 'Customers' AS "table", count(*) AS rows FROM s_customers
UNION ALL SELECT 'Departments', count(*) FROM s_departments
UNION ALL SELECT 'Users', count(*) FROM s_users UNION ALL SELECT 'Products', count(*) FROM s_products
UNION ALL SELECT 'Leads', count(*) FROM s_leads
UNION ALL SELECT 'Installations', count(*) FROM s_installations
UNION ALL SELECT 'Accounts', count(*) FROM s_accounts UNION ALL SELECT 'Sales', count(*) FROM s_sales""")
def all_sheets(spark, root):
    return sinks.row_counts(readers.read_sheets(spark, _exported(spark, root, SHEETS)))


@query("s01_read_all_tables", _count(TABLES))
def all_tables(spark, root):
    return sinks.row_counts(readers.read_tables(spark, root, TABLES))


@query("s02_read_named_sheets", """
SELECT 'Leads' AS "table", count(*) AS rows FROM s_leads
UNION ALL SELECT 'Sales', count(*) FROM s_sales""")
def named_sheets(spark, root):
    names = ["Leads", "Sales"]
    return sinks.row_counts(readers.read_sheets(spark, _exported(spark, root, names), names))


@query("s03_first_usable_input", "SELECT count(*) AS orders FROM orders")
def first_usable(spark, root):
    found = readers.resolve_input(spark, [f"{root}/missing", root], ["orders", "lineitem"],
                                  ".parquet")
    return table(spark, found, "orders").agg(F.count("*").alias("orders"))


def _part_csv(spark, root: str) -> str:
    path = scratch(spark, root, "part_csv")
    table(spark, root, "part").write.mode("overwrite").option("header", True).csv(path)
    return path


@query("s04_read_csv_inferred", "SELECT * FROM part")
def csv_inferred(spark, root):
    return readers.read_csv(spark, _part_csv(spark, root))


@query("s05_read_parquet", "SELECT * FROM orders WHERE o_totalprice > 300000".replace(
    "*", "o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate"))
def parquet(spark, root):
    return readers.read_parquet(spark, f"{root}/orders.parquet") \
        .where("o_totalprice > 300000").select("o_orderkey", "o_totalprice", "o_orderdate")


@query("s06_read_csv", "SELECT p_partkey, p_name, p_retailprice FROM part")
def csv(spark, root):
    schema = ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
              "p_retailprice double")
    return readers.read_csv(spark, _part_csv(spark, root), schema).select(
        "p_partkey", "p_name", "p_retailprice")


@query("s07_read_table_or_none", """
SELECT 'orders' AS name, true AS found, count(*) AS rows FROM orders""")
def table_or_none(spark, root):
    name = view(spark, root, "stored_orders", table(spark, root, "orders"))
    assert readers.read_table_or_none(spark, "no_such_table") is None
    return readers.read_table_or_none(spark, name).agg(F.count("*").alias("rows")).select(
        F.lit("orders").alias("name"), F.lit(True).alias("found"), "rows")


@query("s08_prefer_stored_mart", """
SELECT country_name, count(*) AS accounts FROM mart_customers GROUP BY 1""")
def prefer_mart(spark, root):
    w = warehouse(spark, root)
    name = view(spark, root, "stored_mart", w["mart_customer_account_analytics"])
    mart = readers.load_customer_mart(spark, lambda: w["customer_table"], name)
    return mart.groupBy("country_name").agg(F.count("*").alias("accounts"))


@query("s09_customers_with_segments", """
SELECT customer_id, country_name, segment_id, segment_name FROM segmented""")
def customers_with_segments(spark, root):
    path = sinks.write_parquet(
        segment_labels(spark, root).withColumn("country_name", F.lit("stale")),
        scratch(spark, root, "segment_labels"))
    labelled = with_segments(customer_table(spark, root), readers.read_parquet(spark, path))
    return labelled.select("customer_id", "country_name", "segment_id", "segment_name")


@query("s10_derived_keys_match_dimension", """
SELECT country_name, count(*) AS sales FROM fact_sales JOIN dim_country USING (country_id) GROUP BY 1""")
def keys_match(spark, root):
    w = warehouse(spark, root)
    return w.plan("fact_sales").join(w["dim_country"], "country_id") \
        .groupBy("country_name").agg(F.count("*").alias("sales"))


@query("s11_run_select", """
SELECT 'o_orderpriority, n' AS columns, 5 AS row_count, false AS truncated, o_orderpriority, count(*) AS n
FROM orders GROUP BY 4""")
def run_select(spark, root):
    name = view(spark, root, "select_orders", table(spark, root, "orders"))
    sql = f"SELECT o_orderpriority, count(*) AS n FROM {name} GROUP BY 1 ;"
    result = catalog.run_select(spark, sql)
    return catalog.select_frame(spark, sql).select(
        F.lit(", ".join(result.columns)).alias("columns"),
        F.lit(result.row_count).alias("row_count"), F.lit(result.truncated).alias("truncated"), "*")


@query("s11_run_select_truncated", """
SELECT least(count(*), 200) AS shown, count(*) AS row_count, count(*) > 200 AS truncated
FROM customer""")
def run_select_truncated(spark, root):
    name = view(spark, root, "select_customers", table(spark, root, "customer"))
    result = catalog.run_select(spark, f"SELECT c_custkey FROM {name}")
    return spark.createDataFrame([(len(result.rows), result.row_count, result.truncated)],
                                 "shown int, row_count bigint, truncated boolean")


@query("s12_table_inventory", _count(["nation", "orders"]))
def inventory(spark, root):
    names = {view(spark, root, f"inventory_{n}", table(spark, root, n)): n
             for n in ("nation", "orders")}
    label = F.lit(None)
    for full, short in names.items():
        label = F.when(F.col("table") == full, short).otherwise(label)
    counts = catalog.inventory(spark).where(F.col("table").isin(list(names)))
    return counts.select(label.alias("table"), "rows")


@query("s13_describe_tables", """
SELECT table_name AS "table", CAST(row_number() OVER (PARTITION BY table_name ORDER BY column_index)
    AS INTEGER) AS position, column_name AS "column",
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END AS type
FROM duckdb_columns() WHERE table_name IN ('orders', 'part')""")
def describe_tables(spark, root):
    return catalog.describe_tables(spark, {n: table(spark, root, n) for n in ("orders", "part")})


@query("s14_preview", """
SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 5""")
def preview(spark, root):
    customers = table(spark, root, "customer").select("c_custkey", "c_name")
    return ordering.preview(customers, [F.col("c_name").desc(), "c_custkey"])


# --- Sinks ---------------------------------------------------------------------------------------

@query("k01_write_customer_base", """
SELECT customer_id, country_name, financed_amount, risk_stress_score FROM customer_table""")
def write_base(spark, root):
    path = sinks.write_parquet(customer_table(spark, root), scratch(spark, root, "customer_base"))
    return readers.read_parquet(spark, path).select(
        "customer_id", "country_name", "financed_amount", "risk_stress_score")


@query("k02_write_segments", """
SELECT customer_id, segment_id, segment_name, country_name FROM segmented""")
def write_segments(spark, root):
    path = sinks.write_segments(segmented(spark, root), scratch(spark, root, "segments"))
    return readers.read_parquet(spark, path)


@query("k03_append_rows", "SELECT status, count(*) AS rows FROM s_accounts GROUP BY 1")
def append(spark, root):
    name, path = own_name(spark, root, "appended"), scratch(spark, root, "appended")
    drop_table(spark, name)
    accounts = sheet(spark, root, "Accounts").select("id", "status")
    sinks.rebuild_table(accounts.where("status IS NULL"), name, path)
    sinks.append_table(accounts.where("status IS NOT NULL").select("status", "id"), name)
    sinks.append_table(accounts.where("false"), name)
    return spark.read.table(name).groupBy("status").agg(F.count("*").alias("rows"))


@query("k04_month_partitions", f"""
SELECT sale_id, {d('sale_date')}, country_id FROM fact_sales
WHERE sale_date BETWEEN DATE '1997-02-10' AND DATE '1997-05-20'""")
def month_partitions(spark, root):
    path = sinks.write_by_month(warehouse(spark, root)["fact_sales"],
                                scratch(spark, root, "fact_sales_by_month"), "sale_date",
                                ["country_id", "sale_date"])
    return sinks.read_months(spark, path, "sale_date", "1997-02-10", "1997-05-20").select(
        "sale_id", "sale_date", "country_id")


@query("k04_e08_e13_refresh_of_changed_months", """
SELECT strftime(sale_date, '%Y%m') AS month, count(*) AS rows, count(DISTINCT sale_date) AS days,
  coalesce(strftime(sale_date, '%Y%m') = '199503', false) AS fact_rewritten,
  coalesce(strftime(sale_date, '%Y%m') = '199503', false) AS mart_rewritten, false AS other_fact_rewritten
FROM (SELECT CASE WHEN sale_date BETWEEN DATE '1995-03-20' AND DATE '1995-03-31' THEN DATE '1995-03-19'
  ELSE sale_date END AS sale_date FROM fact_sales) GROUP BY ALL""")
def refreshed_months(spark, root):
    """A load, then a load of sheets in which sales of one month have moved to another day."""
    path = f"{scratch(spark, root, 'refreshed')}-{uuid4().hex}"
    kept = warehouse(spark, root)

    def moved(name: str):
        df = kept.sheet(name)
        late = F.col("Sale_date").between("1995-03-20", "1995-03-31") if name == "Sales" else F.lit(False)
        return df if name != "Sales" else df.withColumn(
            "Sale_date", F.when(late, "1995-03-19").otherwise(F.col("Sale_date")))

    for source in (kept.sheet, moved):
        w = Warehouse(spark, source, path, REFERENCE_DATE, resume=True)
        mart, _ = w["mart_sales_performance"], w["fact_accounts_snapshots"]
    written = {n: F.coalesce(F.col("month").isin(w.rewritten.get(n, [])), F.lit(False)) for n in (
        "fact_sales", "mart_sales_performance", "fact_accounts_snapshots")}
    return mart.groupBy(F.date_format("sale_date", "yyyyMM").alias("month")).agg(
        F.count("*").alias("rows"), F.count_distinct("sale_date").alias("days")).select(
        "month", "rows", "days", written["fact_sales"].alias("fact_rewritten"),
        written["mart_sales_performance"].alias("mart_rewritten"),
        written["fact_accounts_snapshots"].alias("other_fact_rewritten"))


@query("k05_rebuild_mart", """
SELECT product_tier, count(*) AS rows FROM mart_customers GROUP BY 1""")
def rebuild(spark, root):
    name, path = own_name(spark, root, "mart"), scratch(spark, root, "rebuilt_mart")
    drop_table(spark, name)
    plan = warehouse(spark, root).plan("mart_customer_account_analytics")
    sinks.rebuild_table(plan.where("false"), name, path)
    sinks.rebuild_table(plan, name, path)
    return spark.read.table(name).groupBy("product_tier").agg(F.count("*").alias("rows"))


@query("k06_load_if_empty", """
SELECT true AS first_load, false AS second_load, count(*) AS rows FROM dim_customer""")
def load_if_empty(spark, root):
    name, path = own_name(spark, root, "dim_customer"), scratch(spark, root, "dim_customer_once")
    drop_table(spark, name)
    w = warehouse(spark, root)
    build = lambda: w.plan("dim_customer")
    first = sinks.load_if_empty(spark, name, build, path)
    second = sinks.load_if_empty(spark, name, build, path)
    return spark.read.table(name).agg(F.count("*").alias("rows")).select(
        F.lit(first).alias("first_load"), F.lit(second).alias("second_load"), "rows")


@query("k08_v05_checked_dry_run", """
SELECT lead_source_id, count(*) AS rows, CAST(sum(lead_id) AS BIGINT) AS ids
FROM fact_lead_funnel_numeric GROUP BY 1""")
def dry_run(spark, root):
    funnel = warehouse(spark, root)["fact_lead_funnel_numeric"]
    path = scratch(spark, root, "funnel_preview")
    # Bad lead dates fail the check on dates, so the dry run skips validation.
    sinks.load_checked(funnel, run_checks(funnel, funnel_checks()), lambda df: None,
                       preview_path=path, skip_validation=True)
    preview = readers.read_csv(spark, path)
    return preview.groupBy("lead_source_id").agg(
        F.count("*").alias("rows"), F.sum("lead_id").alias("ids"))


@query("v05_failed_checks_abort_the_load", """
SELECT true AS aborted, 0 AS writes, count(*) AS rows FROM fact_lead_funnel_numeric""")
def aborted_load(spark, root):
    """Bad lead dates fail the check on dates: nothing is written."""
    funnel = warehouse(spark, root)["fact_lead_funnel_numeric"]
    writes, aborted = [], False
    try:
        sinks.load_checked(funnel, run_checks(funnel, funnel_checks()), writes.append)
    except ValidationError:
        aborted = True
    return funnel.agg(F.count("*").alias("rows")).select(
        F.lit(aborted).alias("aborted"), F.lit(len(writes)).alias("writes"), "rows")


@query("k11_input_audit", """
SELECT 'file' AS source, 'orders' AS name, count(*) AS row_count, 6 AS column_count FROM orders""")
def input_audit(spark, root):
    log = scratch(spark, root, "input_audit")
    spark.createDataFrame([], audit.INPUT_SCHEMA).write.mode("overwrite").parquet(log)
    audit.write_audited_input(
        table(spark, root, "orders"), "file", "orders",
        lambda df: sinks.write_parquet(df, scratch(spark, root, "orders_copy")), log)
    return readers.read_parquet(spark, log).select("source", "name", "row_count", "column_count")


@query("k12_transformation_audit", """
SELECT 'raw' AS input_dataset, 'kept' AS output_dataset, 'dropna' AS method,
  '{"subset": ["status"]}' AS parameters, count(*) AS rows_in, count(status) AS rows_out,
  'late' AS added FROM s_accounts""")
def transformation_audit(spark, root):
    log = scratch(spark, root, "transformation_audit")
    spark.createDataFrame([], audit.TRANSFORMATION_SCHEMA).write.mode("overwrite").parquet(log)
    audit.write_audited(
        sheet(spark, root, "Accounts"),
        lambda df: df.na.drop(subset=["status"]).withColumn("late", F.lit(False)),
        "dropna", {"subset": ["status"]}, ("raw", "kept"),
        lambda df: sinks.write_parquet(df, scratch(spark, root, "accounts_kept")), log)
    return readers.read_parquet(spark, log).select(
        "input_dataset", "output_dataset", "method", "parameters", "rows_in", "rows_out",
        F.concat_ws(",", "columns_added").alias("added"))


@query("v01_required_columns", """
SELECT true AS complete, count(*) AS customers FROM customer_table""")
def required(spark, root):
    customers = customer_table(spark, root)
    complete = require_columns(customers, ["customer_id", "age"])
    return customers.agg(F.count("*").alias("customers")).select(
        F.lit(complete).alias("complete"), "customers")
