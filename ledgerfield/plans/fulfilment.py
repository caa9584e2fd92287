"""Installation backlog and delays.

Delays are whole days, so exact medians and percentiles hold one counter per distinct day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerfield.functions.dates import calendar_days, elapsed_days, month_start, parse_timestamp
from ledgerfield.functions.numbers import round_even
from ledgerfield.operators.aggregates import count_by, pivot_values, rows_from_one
from ledgerfield.operators.describe import describe_numeric, histogram
from ledgerfield.operators.joins import without_match
from ledgerfield.operators.quantiles import stored
from ledgerfield.plans.growth import with_country_names


def _delay():
    return calendar_days(F.col("installation_date"), F.col("sale_date"))


def backlog(fact_sales: DataFrame, fact_installations: DataFrame) -> DataFrame:
    """Sales whose account has no installation."""
    return without_match(fact_sales, fact_installations, "account_id", "account_id")


def backlog_by_country(fact_sales: DataFrame, fact_installations: DataFrame,
                       dim_country: DataFrame) -> DataFrame:
    counts = count_by(backlog(fact_sales, fact_installations), ["country_id"], "uninstalled_sales")
    return with_country_names(counts, dim_country).select("country_name", "uninstalled_sales")


def valid_delays_by_country(fact_installations: DataFrame, dim_country: DataFrame) -> DataFrame:
    valid = fact_installations.where(_delay() >= 0).groupBy("country_id").agg(
        F.count("*").alias("installed_count"),
        F.avg(_delay()).alias("avg_delay"),
        F.median(_delay()).alias("median_delay"))
    return with_country_names(valid, dim_country).drop("country_id")


def negative_delays_by_country(fact_installations: DataFrame,
                               dim_country: DataFrame) -> DataFrame:
    counts = fact_installations.groupBy("country_id").agg(
        F.count_if(_delay() < 0).alias("negative_delays"), F.count("*").alias("total"))
    share = counts.withColumn("pct_negative", F.col("negative_delays") * 100.0 / F.col("total"))
    return with_country_names(share, dim_country).drop("country_id")


def delay_table(fact_installations: DataFrame, dim_country: DataFrame,
                countries: list[str]) -> DataFrame:
    """Mean delay per sale month x country over installed rows, 0 where there are none."""
    installed = fact_installations.where(
        (F.col("installation_status") == "Installed") | F.col("installation_date").isNotNull())
    months = installed.select("country_id", month_start(F.col("sale_date")).alias("month"),
                              _delay().alias("delay")).na.drop(subset=["month"])
    # Sums and counts first, so that names are joined to few rows.
    sums = months.groupBy("country_id", "month").agg(
        F.sum("delay").alias("days"), F.count("delay").alias("n"))
    named = with_country_names(sums, dim_country)
    return pivot_values(named, "month", "country_name", countries,
                        F.try_divide(F.sum("days").cast("double"), F.sum("n")), 0.0)


def status_table(fact_installations: DataFrame, dim_country: DataFrame,
                 countries: list[str]) -> DataFrame:
    counts = count_by(fact_installations.na.drop(subset=["installation_status"]),
                      ["country_id", "installation_status"])
    return pivot_values(with_country_names(counts, dim_country), "installation_status",
                        "country_name", countries, F.sum("count"), 0)


def delay_distribution(mart_installations: DataFrame, low: int = -30, high: int = 90,
                       bins: int = 30) -> DataFrame:
    """Bin counts per country over delays between low and high, with the country's median."""
    kept = mart_installations.where(F.col("installation_delay_days").between(low, high))
    medians = kept.groupBy("country_name").agg(
        F.median("installation_delay_days").alias("median_delay"))
    return histogram(kept, "installation_delay_days", bins, ["country_name"]).join(
        medians, "country_name")


def reconcile(fact_sales: DataFrame, fact_installations: DataFrame) -> DataFrame:
    """Counts on both sides and how many rows' accounts miss on the other one.

    Both facts are read once and counted per account; the counts meet in one outer join. A row without an
    account matches nothing.
    """
    counted = count_by(fact_sales, ["account_id"], "sales").join(
        count_by(fact_installations, ["account_id"], "installations")
        .withColumnRenamed("account_id", "installed_account"),
        F.col("account_id") == F.col("installed_account"), "full")
    total = lambda column, kept=F.lit(True): F.coalesce(F.sum(F.when(kept, F.col(column))), F.lit(0))
    one = counted.agg(
        total("sales").alias("a"), total("installations").alias("b"),
        total("sales", F.col("installations").isNull()).alias("c"),
        total("installations", F.col("sales").isNull()).alias("d"))
    return rows_from_one(one, [
        [("measure", F.lit(name)), ("value", F.col(c))] for name, c in (
            ("sales", "a"), ("installations", "b"), ("sales_without_installation", "c"),
            ("installations_without_sale", "d"))])


def raw_delays(sheets: dict[str, DataFrame]) -> DataFrame:
    """Accounts with a sale and an installation, with the elapsed days between the two."""
    accounts = sheets["Accounts"].select("id", "Installation_id")
    sales = sheets["Sales"].select(F.col("account_id").alias("account"), "Sale_date")
    installations = sheets["Installations"].select(F.col("Id").alias("installation"),
                                                   "Installation_date")
    joined = accounts.join(sales, F.col("id") == F.col("account")) \
        .join(installations, F.col("Installation_id") == F.col("installation"))
    sold = parse_timestamp(F.col("Sale_date"))
    installed = parse_timestamp(F.col("Installation_date"))
    return joined.select(
        "id", sold.alias("sale_date"), "Installation_id", installed.alias("installation_date"),
        elapsed_days(installed, sold).alias("delay"))


def raw_delay_statistics(sheets: dict[str, DataFrame]) -> DataFrame:
    """The joins run once; the passes of the statistics read their written result."""
    return describe_numeric(stored(raw_delays(sheets).select("delay")), ["delay"])


def raw_delay_samples(sheets: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """First n accounts with a negative delay and first n with a valid one."""
    delays = raw_delays(sheets)
    negative = delays.where("delay < 0").orderBy("id").limit(n)
    valid = delays.where("delay >= 0").orderBy("id").limit(n)
    return negative.withColumn("kind", F.lit("negative")).unionByName(
        valid.withColumn("kind", F.lit("valid")))


def delay_sign_counts(sheets: dict[str, DataFrame]) -> DataFrame:
    return raw_delays(sheets).agg(
        F.count_if(F.col("delay") < 0).alias("negative"),
        F.count_if(F.col("delay") >= 0).alias("valid"),
        round_even(F.avg("delay"), 4).alias("mean_delay"))


def customer_timeline(sheets: dict[str, DataFrame]) -> DataFrame:
    """Dates of every step from customer to installation, one row per account."""
    day = lambda c: parse_timestamp(F.col(c)).cast("date")
    customers = sheets["Customers"].select(
        F.col("id").alias("customer_id"), "region", day("created_at").alias("customer_created"))
    accounts = sheets["Accounts"].select(
        F.col("id").alias("account_id"), F.col("customer_id").alias("owner"),
        day("created_at").alias("account_created"), "Installation_id", "lead_id",
        day("First_installment_date").alias("first_installment"),
        day("Dispatch_date").alias("dispatched"))
    leads = sheets["Leads"].select(F.col("Id").alias("lead"),
                                   day("created_at").alias("lead_created"))
    sales = sheets["Sales"].select(F.col("account_id").alias("sold_account"),
                                   day("Sale_date").alias("sale_date"))
    installations = sheets["Installations"].select(
        F.col("Id").alias("installation"), day("Installation_date").alias("installation_date"))
    return (
        customers.join(accounts, F.col("customer_id") == F.col("owner"))
        .join(leads, F.col("lead_id") == F.col("lead"), "left")
        .join(sales, F.col("account_id") == F.col("sold_account"), "left")
        .join(installations, F.col("Installation_id") == F.col("installation"), "left")
        .select("customer_id", "region", "account_id", "customer_created", "lead_created",
                "account_created", "sale_date", "installation_date", "dispatched",
                "first_installment")
    )
