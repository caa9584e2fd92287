"""Ad-hoc SQL and table inventory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from ledgerfield.sources.sinks import row_counts


@dataclass
class SelectResult:
    columns: list[str]
    rows: list[Row]
    row_count: int
    truncated: bool


def select_frame(spark: SparkSession, sql: str) -> DataFrame:
    """The query as a frame; anything but SELECT is refused."""
    statement = sql.strip().rstrip(";")
    if not statement.lower().startswith("select"):
        raise ValueError("Only SELECT queries are allowed")
    return spark.sql(statement)


def run_select(spark: SparkSession, sql: str, max_rows: int = 200) -> SelectResult:
    """At most max_rows rows on the driver, with the full row count."""
    df = select_frame(spark, sql)
    rows = df.limit(max_rows + 1).collect()
    truncated = len(rows) > max_rows
    count = df.count() if truncated else len(rows)
    return SelectResult(df.columns, rows[:max_rows], count, truncated)


def inventory(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, rows) of all tables and views of a database."""
    names = [t.name for t in spark.catalog.listTables(database)]
    if not names:
        return spark.createDataFrame([], "table string, rows bigint")
    prefix = f"{database}." if database else ""
    return row_counts({n: spark.read.table(prefix + n) for n in names})


def describe_tables(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type); no data is read."""
    rows = [(name, i, f.name, f.dataType.simpleString())
            for name, df in frames.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")
