"""The eight raw sheets, derived from the given tables.

Orders stand for leads, accounts and sales; the first line of an order is its installation.
Remainders of keys make the irregular values that the load has to cope with; rows without a match
have altered keys, so every given row is carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfield.operators.quantiles import stored
from ledgerfield.plans.warehouse import Warehouse
from ledgerfield.sources.readers import read_parquet, stored_bytes
from ledgerfield.sources.scratch import scratch_path

REFERENCE_DATE = "2025-01-01"

# Display names and raw regions the bindings produce, in the order of the region keys.
REGIONS = ["kenya", "uganda", "civ", "europe", "middle east"]
COUNTRIES = ["Kenya", "Uganda", "Côte d'Ivoire", "Europe", "Middle East"]
SOURCES = ["Roadshow", "Refer and Earn", "Facebook", "Website", "Walk-in"]
STATUSES = ["Complete", "Advance", "Refunded", "Arrears", "No Deposit", "Write Off",
            "Repossession", "Repossed"]

DEALT_BYTES = 32 << 20  # of a table up to which its rows are dealt over the cores
WRITTEN_SHEETS = ("Accounts",)  # a join; the other sheets are columns of one table

STAMP = "yyyy-MM-dd HH:mm:ss"


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table. A small one in fewer files than there are cores is dealt over them, as a file of one row
    group is one task otherwise; a large one has many row groups and is read in splits, without a shuffle."""
    path, cores = f"{root}/{name}.parquet", spark.sparkContext.defaultParallelism
    rows = read_parquet(spark, path)
    if len(rows.inputFiles()) >= cores or stored_bytes(spark, path) > DEALT_BYTES:
        return rows
    return rows.repartition(cores)


def _stamp(expression: str):
    return F.date_format(F.expr(expression), STAMP)


def _day(expression: str):
    return F.date_format(F.expr(expression), "yyyy-MM-dd")


def customers(spark: SparkSession, root: str) -> DataFrame:
    nation = _table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey")
    df = _table(spark, root, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    region = F.element_at(F.array(*[F.lit(r) for r in REGIONS]), F.col("n_regionkey") + 1)
    return df.select(
        F.expr("concat('C', c_custkey)").alias("id"),
        F.expr("CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Female' "
               "ELSE 'Male' END").alias("Gender"),
        F.expr("CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN 'unknown' "
               "ELSE cast(date_add(DATE'1930-01-01', cast(c_custkey * 37 % 29000 AS int)) "
               "AS string) END").alias("Date_of_birth"),
        F.when(F.expr("c_custkey % 97 <> 0"), region).alias("region"),
        F.when(F.expr("c_custkey % 89 <> 0"), F.col("n_name")).alias("Location"),
        F.when(F.expr("c_custkey % 7 <> 0"), F.col("c_acctbal") / 100.0).alias("Latitude"),
        (F.col("c_acctbal") / -50.0).alias("Longitude"),
        _stamp("TIMESTAMP_NTZ'1994-01-01 08:00:00' + make_dt_interval(c_custkey % 300)")
        .alias("created_at"),
    )


def departments(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "nation").select(
        F.expr("concat('D', n_nationkey)").alias("Id"), F.col("n_name").alias("name"))


def users(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "supplier").select(
        F.expr("concat('U', s_suppkey)").alias("Id"), F.col("s_name").alias("Name"),
        F.expr("concat('D', s_nationkey)").alias("departmentId"),
        _stamp("TIMESTAMP_NTZ'1994-06-01 00:00:00' + make_dt_interval(s_suppkey % 60)")
        .alias("created_at"))


def products(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "part").select(
        F.expr("concat('P', p_partkey)").alias("Id"), F.col("p_name").alias("Product"),
        F.expr("CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN true WHEN p_type = 'PROMO' "
               "THEN NULL ELSE false END").alias("is_refurb"),
        _stamp("TIMESTAMP_NTZ'1994-01-01 00:00:00' + make_dt_interval(p_partkey % 30)")
        .alias("created_at"))


def leads(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, root, "orders").select(
        F.expr("concat('LEAD-', o_orderkey)").alias("Id"),
        F.expr("CASE WHEN o_orderkey % 37 <> 0 THEN concat('C', o_custkey) END")
        .alias("customer_id"),
        F.expr("CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 'Billboard' "
               "ELSE element_at(array('Roadshow', 'Refer and Earn', 'Facebook', 'Website', "
               "'Walk-in'), cast(left(o_orderpriority, 1) AS int)) END").alias("Source"),
        F.when(F.expr("o_orderkey % 211 = 0"), "bad").otherwise(_stamp(
            "o_orderdate - make_dt_interval(o_orderkey % 120) "
            "+ make_dt_interval(0, o_orderkey % 24) "
            "+ make_dt_interval(CASE WHEN o_orderkey % 29 = 0 THEN 130 ELSE 0 END)"))
        .alias("created_at"))


_lines: dict[tuple[str, str], DataFrame] = {}


def first_lines(spark: SparkSession, root: str) -> DataFrame:
    """First line per order, combined before the shuffle; two sheets need it, so it is written once."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _lines:
        line = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")).alias("f")
        _lines[key] = stored(_table(spark, root, "lineitem").groupBy("l_orderkey").agg(line).select(
            "l_orderkey", F.col("f.l_partkey").alias("l_partkey"),
            F.col("f.l_suppkey").alias("l_suppkey"), F.col("f.l_shipdate").alias("l_shipdate")))
    return _lines[key]


def accounts(spark: SparkSession, root: str) -> DataFrame:
    orders = _table(spark, root, "orders")
    df = orders.join(first_lines(spark, root), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df.select(
        F.expr("concat(if(o_orderkey % 10 = 0, 'B', 'A'), o_orderkey)").alias("id"),
        F.expr("concat('C', o_custkey)").alias("customer_id"),
        F.expr(
            "CASE WHEN o_orderkey % 307 = 0 THEN NULL "
            "WHEN o_orderstatus = 'F' THEN element_at(array('Complete', 'Advance', 'Refunded'), "
            "cast(o_orderkey % 3 + 1 AS int)) "
            "WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 11 = 0 THEN 'Arrears' "
            "WHEN o_orderkey % 17 = 0 THEN 'No Deposit' ELSE 'Complete' END "
            "WHEN o_orderkey % 19 = 0 THEN 'Write Off' "
            "WHEN o_orderkey % 23 = 0 THEN 'Repossession' "
            "WHEN o_orderkey % 29 = 0 THEN 'Repossed' ELSE 'Advance' END")
        .alias("status"),
        F.expr("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PAYG' ELSE 'CASH' END")
        .alias("type"),
        _stamp("o_orderdate + make_dt_interval(o_orderkey % 3, 6)").alias("created_at"),
        _stamp("o_orderdate + make_dt_interval(o_orderkey % 3 + 1, 6)").alias("updated_at"),
        F.expr("CASE WHEN l_orderkey IS NOT NULL AND o_orderkey % 13 <> 0 "
               "THEN concat('I', o_orderkey) END").alias("Installation_id"),
        F.when(F.expr("o_orderkey % 19 <> 0"),
               _day("o_orderdate + make_dt_interval(o_orderkey % 30 - 5)")).alias("Dispatch_date"),
        F.when(F.expr("o_orderkey % 23 <> 0"), _day("o_orderdate + make_dt_interval(30)"))
        .alias("First_installment_date"),
        F.expr("concat('U', l_suppkey)").alias("Agent_id"),
        F.expr("concat('P', l_partkey)").alias("Proudct_id"),
        F.expr("CASE WHEN o_orderkey % 61 <> 0 AND o_orderkey % 10 <> 0 THEN concat('LEAD-', o_orderkey) END")
        .alias("lead_id"),
    )


def sales(spark: SparkSession, root: str) -> DataFrame:
    orders = _table(spark, root, "orders")
    return orders.select(
        F.expr("concat('S', o_orderkey)").alias("Id"),
        F.expr("concat(if(o_orderkey % 17 = 0, 'N', 'A'), o_orderkey)").alias("account_id"),
        F.when(F.expr("o_orderkey % 101 = 0"), "n/a").otherwise(_day("o_orderdate"))
        .alias("Sale_date"),
        _stamp("o_orderdate + make_dt_interval(0, 9)").alias("created_at"),
        _stamp("o_orderdate + make_dt_interval(1, 9)").alias("updated_at"))


def installations(spark: SparkSession, root: str) -> DataFrame:
    return first_lines(spark, root).select(
        F.expr("concat('I', l_orderkey)").alias("Id"),
        F.when(F.expr("l_orderkey % 31 <> 0"), _day("l_shipdate")).alias("Installation_date"),
        F.expr("concat('U', l_suppkey)").alias("engineer_id"),
        _stamp("l_shipdate + make_dt_interval(1)").alias("created_at"),
        _stamp("l_shipdate + make_dt_interval(2)").alias("updated_at"))


BUILDERS = {
    "Customers": customers, "Departments": departments, "Users": users, "Products": products,
    "Leads": leads, "Installations": installations, "Accounts": accounts, "Sales": sales,
}

_warehouses: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, root: str) -> Warehouse:
    """One warehouse per application and data folder, facts and marts in month folders."""
    root = root.rstrip("/")
    key = (spark.sparkContext.applicationId, root)
    if key not in _warehouses:
        name = root.strip("/").replace("/", "_")
        use(spark, root, Warehouse(
            spark, lambda sheet: BUILDERS[sheet](spark, root),
            scratch_path(spark, "warehouse", name), REFERENCE_DATE,
            store_sheets=WRITTEN_SHEETS))
    return _warehouses[key]


def use(spark: SparkSession, root: str, built: Warehouse) -> None:
    """Let the registered queries read an already built warehouse."""
    _warehouses[(spark.sparkContext.applicationId, root.rstrip("/"))] = built
