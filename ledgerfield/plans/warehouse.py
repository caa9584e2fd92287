"""The load: sheets -> dimensions -> facts -> marts -> account and customer tables.

Each table is one lazy plan and one write. A table is built when it is first asked for, from written
inputs, so a later step never repeats an earlier one and the optimizer sees real sizes.

A load that keeps state can stop anywhere and go on: when a table is finished, a row beside it says what
it was made of. Inputs are compared by order-free digests of their rows. A table whose inputs are as they
were is not touched; of a fact or mart that lies in month folders only the months whose rows have changed
are written again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerfield.constants import SHEETS
from ledgerfield.plans import customers, dimensions, facts, marts
from ledgerfield.sources.readers import path_exists
from ledgerfield.sources.sinks import replace_months, write_by_month

# Column whose month partitions a fact, and the sort keys inside its files.
FACT_LAYOUT = {
    "fact_sales": ("sale_date", ["country_id", "sale_date"]),
    "fact_accounts_snapshots": ("created_at", ["country_id", "account_id"]),
    "fact_installations": ("installation_date", ["country_id", "installation_date"]),
    "fact_lead_funnel": ("lead_created_date", ["lead_created_date", "lead_id"]),
}
# The same for the marts, which go by the dates of their facts.
MART_LAYOUT = {
    "mart_customer_account_analytics": ("created_at", ["country_id", "customer_id"]),
    "mart_sales_performance": ("sale_date", ["country_id", "sale_date"]),
    "mart_installation_operations": ("installation_date", ["country_id", "installation_date"]),
}
LAYOUT = FACT_LAYOUT | MART_LAYOUT
STATE_SCHEMA = "version string, inputs map<string, string>, months map<string, string>, columns string"


def digest() -> Column:
    """Of the rows of a group, whatever their order: how many, and the sum of their hashes."""
    return F.concat_ws(":", F.count("*"), F.sum(F.col("__hash").cast("decimal(38,0)")))


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("__hash", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def hash_of(months: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(months, sort_keys=True).encode()).hexdigest()


class Warehouse:
    """Tables below ``root``, built from sheets on demand.

    ``sheet`` gives a raw sheet by name. ``month_partitions`` stores facts and marts in month folders.
    Sheets are read where they lie; ``store_sheets`` writes each once, or those named, which pays when a
    sheet is itself a query or a slow format. ``resume`` keeps state below ``root/_state`` and reads every sheet once
    more for its digest; a warehouse opened again at the same root then builds only what has changed, and
    ``rewritten`` says what that was (None: the whole table).
    """

    def __init__(self, spark: SparkSession, sheet: Callable[[str], DataFrame], root: str,
                 reference_date: str, month_partitions: bool = True, store_sheets: bool | Collection[str] = False,
                 resume: bool = False):
        self.spark = spark
        self.root = root
        self.reference_date = reference_date
        self.month_partitions = month_partitions
        self.store_sheets = store_sheets
        self.resume = resume
        self.rewritten: dict[str, list[str | None] | None] = {}
        self._sheet = sheet
        self._written: dict[str, StructType] = {}
        self._versions: dict[str, str] = {}
        self._asked: list[set[str]] = []  # inputs of the tables being built

    def sheet(self, name: str) -> DataFrame:
        self._ask(f"sheets/{name}")
        if not (self.store_sheets if isinstance(self.store_sheets, bool) else name in self.store_sheets):
            return self._sheet(name)
        return self._stored(f"sheets/{name}", lambda: self._sheet(name))

    def sheets(self) -> dict[str, DataFrame]:
        return {name: self.sheet(name) for name in SHEETS}

    def __getitem__(self, name: str) -> DataFrame:
        self._ask(name)
        return self._stored(name, lambda: self.plan(name))

    def plan(self, name: str) -> DataFrame:
        """The table's plan over its written inputs, not yet written itself."""
        return getattr(self, f"_{name}")()

    def _ask(self, name: str) -> None:
        if self._asked:
            self._asked[-1].add(name)

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if name not in self._written:
            if self.resume and not name.startswith("sheets/"):
                self._written[name] = self._kept(name, path, build)
            else:
                df = build()
                self._write(name, df, path)
                self._written[name] = df.schema
        # The schema is known, so no file footer is read to find it; the folder's month is left out.
        schema = self._written[name]
        return self.spark.read.schema(schema).parquet(path).select(*[f"`{c}`" for c in schema.names])

    def _write(self, name: str, df: DataFrame, path: str) -> None:
        if self.month_partitions and name in LAYOUT:
            write_by_month(df, path, *LAYOUT[name])
        else:
            sort = MART_LAYOUT.get(name, ("", []))[1]
            (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)

    def _version(self, name: str) -> str:
        """What an input holds now; a table is brought up to date for it."""
        if name not in self._versions:
            if name.startswith("sheets/"):
                rows = self._sheet(name.removeprefix("sheets/"))
                self._versions[name] = hashed(rows).agg(digest()).first()[0]
            else:
                self._stored(name, lambda: self.plan(name))
        return self._versions[name]

    def _kept(self, name: str, path: str, build: Callable[[], DataFrame]) -> StructType:
        """The table, as it was or brought up to date; the row of state comes last."""
        at = f"{self.root}/_state/{name}"
        layout = f"{self.reference_date}|{self.month_partitions}"
        state = self.spark.read.schema(STATE_SCHEMA).parquet(at).first() if path_exists(self.spark, at) else None
        if state and state["inputs"].get("layout") == layout and all(
                self._version(k) == v for k, v in state["inputs"].items() if k != "layout"):
            self._versions[name] = state["version"]
            return StructType.fromJson(json.loads(state["columns"]))
        self._asked.append(set())
        df = build()
        inputs = {k: self._version(k) for k in sorted(self._asked.pop())} | {"layout": layout}
        if self.month_partitions and name in LAYOUT:
            date, sort = LAYOUT[name]
            old = state["months"] if state and state["inputs"].get("layout") == layout else None
            if old is None:
                # Digests are taken from what was written, so that the plan runs once.
                write_by_month(df, path, date, sort)
                months = self._months(self.spark.read.schema(df.schema).parquet(path).select(
                    *[f"`{c}`" for c in df.columns]), date)
                self.rewritten[name] = None
            else:
                months = self._months(df, date)
                changed = [m or None for m in sorted(months) if old.get(m) != months[m]]
                gone = [m or None for m in sorted(old) if m not in months]
                replace_months(df, path, date, sort, changed, gone)
                self.rewritten[name] = changed + gone
            version = hash_of(months)
        else:
            self._write(name, df, path)
            self.rewritten[name], months = None, {}
            version = hashed(self.spark.read.schema(df.schema).parquet(path)).agg(digest()).first()[0]
        self._versions[name] = version
        self.spark.createDataFrame([(version, inputs, months, df.schema.json())], STATE_SCHEMA).coalesce(
            1).write.mode("overwrite").parquet(at)
        return df.schema

    def _months(self, df: DataFrame, date: str) -> dict[str, str]:
        """Digest per month of the date; rows without one are under the empty text."""
        rows = hashed(df).groupBy(F.date_format(date, "yyyyMM").alias("month")).agg(digest().alias("d"))
        return {r["month"] or "": r["d"] for r in rows.collect()}

    def _dim_country(self):
        return dimensions.dim_country(self.sheet("Customers"))

    def _dim_location(self):
        return dimensions.dim_location(self.sheet("Customers"))

    def _dim_customer(self):
        return dimensions.dim_customer(self.sheet("Customers"), self.reference_date)

    def _dim_product(self):
        return dimensions.dim_product(self.sheet("Products"))

    def _dim_lead_source(self):
        return dimensions.dim_lead_source(self.sheet("Leads"))

    def _dim_department(self):
        return dimensions.dim_department(self.sheet("Departments"))

    def _dim_employee(self):
        return dimensions.dim_employee(self.sheet("Users"))

    def _dim_account_status(self):
        return dimensions.dim_account_status(self.sheet("Accounts"))

    def _fact_sales(self):
        return facts.fact_sales(self.sheet("Sales"), self.sheet("Accounts"), self.sheet("Leads"),
                                self.sheet("Customers"))

    def _fact_accounts_snapshots(self):
        return facts.fact_accounts_snapshots(self.sheet("Accounts"), self.sheet("Sales"),
                                             self.sheet("Leads"), self.sheet("Customers"))

    def _fact_installations(self):
        return facts.fact_installations(self.sheet("Installations"), self.sheet("Accounts"),
                                        self.sheet("Sales"), self["dim_customer"])

    def _fact_lead_funnel(self):
        return facts.fact_lead_funnel(self.sheet("Leads"), self.sheet("Accounts"),
                                      self.sheet("Sales"))

    def _fact_lead_funnel_numeric(self):
        return facts.fact_lead_funnel_numeric(
            self.sheet("Leads"), self.sheet("Accounts"), self.sheet("Sales"),
            self.sheet("Installations"), self.sheet("Customers"))

    def _mart_customer_account_analytics(self):
        return marts.mart_customer_account_analytics(
            self["fact_accounts_snapshots"], self["dim_customer"], self["dim_country"],
            self["dim_product"], self["dim_account_status"])

    def _mart_sales_performance(self):
        return marts.mart_sales_performance(
            self["fact_sales"], self["dim_country"], self["dim_product"], self["dim_lead_source"],
            self["dim_employee"])

    def _mart_installation_operations(self):
        return marts.mart_installation_operations(
            self["fact_installations"], self["dim_country"], self["dim_product"],
            self["dim_employee"], self["dim_department"])

    def _account_table(self):
        return customers.account_table(self.sheets())

    def _customer_aggregate(self):
        return customers.customer_aggregate(self["account_table"])

    def _customer_table(self):
        return customers.add_features(self["customer_aggregate"])
