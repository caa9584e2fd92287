"""Sinks. One write per table is the only action of a load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfield.operators.quality import ValidationError, passes

NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
SEGMENT_COLUMNS = ["customer_id", "segment_id", "segment_name", "country_name"]


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_segments(customers: DataFrame, path: str) -> str:
    return write_parquet(customers.select(*SEGMENT_COLUMNS), path)


def append_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Append by column name; an empty frame leaves the table as it is.

    ``path`` keeps the files of a new table outside the catalog's own folder.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        df = df.select(*spark.read.table(table).columns)
    _writer(df, "append", path).saveAsTable(table)


def _writer(df: DataFrame, mode: str, path: str | None):
    writer = df.write.mode(mode)
    return writer if path is None else writer.option("path", path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_by_month(df: DataFrame, path: str, date: str, sort_by: list[str]) -> str:
    """Month folders, sorted inside each file.

    ``rebalance`` gathers each month into files of a good size and splits a month that is too big
    for one task, which a plain repartition by month would not.
    """
    months = df.withColumn("month", F.date_format(date, "yyyyMM"))
    (months.hint("rebalance", "month").sortWithinPartitions("month", *sort_by)
     .write.mode("overwrite").partitionBy("month").parquet(path))
    return path


def replace_months(df: DataFrame, path: str, date: str, sort_by: list[str],
                   changed: list[str | None], gone: list[str | None]) -> None:
    """Writes the changed months alone and removes the folders of those that have no rows any more.

    The predicate is on the date, so a plan reads what it needs for these months where it can.
    """
    if changed:
        month = F.date_format(date, "yyyyMM")
        inside = month.isin([m for m in changed if m is not None])
        kept = df.where(inside | month.isNull() if None in changed else inside).withColumn("month", month)
        (kept.hint("rebalance", "month").sortWithinPartitions("month", *sort_by)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month").parquet(path))
    for m in gone:
        remove_path(df.sparkSession, f"{path}/month={NO_MONTH if m is None else m}")


def remove_path(spark: SparkSession, path: str) -> bool:
    """Deletes a folder on whatever file system the cluster has."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_months(spark: SparkSession, path: str, date: str, first: str, last: str) -> DataFrame:
    """Rows dated first..last; the month predicate prunes folders, the date predicate pages."""
    day = F.col(date)
    month = F.col("month").cast("string")
    low, high = (F.lit(d[:7].replace("-", "")) for d in (first, last))
    return spark.read.schema(_schema_with_month(spark, path)).parquet(path) \
        .where(month.between(low, high)) \
        .where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def _schema_with_month(spark: SparkSession, path: str) -> str:
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name != "month"]
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                     + ["month string"])


def rebuild_table(df: DataFrame, table: str, path: str | None = None) -> None:
    _writer(df, "overwrite", path).saveAsTable(table)


def load_if_empty(spark: SparkSession, table: str, build: Callable[[], DataFrame],
                  path: str | None = None) -> bool:
    """Load unless the table has rows already; says whether it loaded."""
    if spark.catalog.tableExists(table) and not spark.read.table(table).isEmpty():
        return False
    rebuild_table(build(), table, path)
    return True


def load_checked(df: DataFrame, report: DataFrame, write: Callable[[DataFrame], object],
                 preview_path: str | None = None, skip_validation: bool = False) -> None:
    """Write after validation; a dry run writes a CSV preview instead."""
    if not skip_validation and not passes(report):
        failed = [r["check"] for r in report.where("severity = 'error' AND NOT passed").collect()]
        raise ValidationError(f"Load aborted, failed checks: {failed}")
    if preview_path is not None:
        df.write.mode("overwrite").option("header", True).csv(preview_path)
    else:
        write(df)


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table, rows)."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_model_card(card: DataFrame, path: str) -> None:
    card.write.mode("overwrite").json(path)


def read_model_card(spark: SparkSession, path: str) -> DataFrame:
    schema = ("model_type string, n_clusters int, random_state int, "
              "k_evaluation array<struct<k: int, inertia: double, silhouette: double, "
              "calinski_harabasz: double, min_cluster_pct: double>>, "
              "segment_names map<string, string>")
    return spark.read.schema(schema).json(path)


def segment_names_of(card: DataFrame) -> DataFrame:
    """(segment_id, segment_name) rows of a model card."""
    return card.select(F.explode("segment_names").alias("id", "segment_name")).select(
        F.col("id").cast("int").alias("segment_id"), "segment_name")
