"""Readers. Schemas are declared where they are known, so nothing is inferred by a scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ledgerfield.constants import SHEETS
from ledgerfield.sources.schemas import RAW_SCHEMAS


def read_sheets(spark: SparkSession, root: str, names: list[str] | None = None,
                fmt: str = "parquet") -> dict[str, DataFrame]:
    """Sheet exports ``root/<sheet>``; a missing one raises."""
    return {name: read_sheet(spark, f"{root}/{name}", RAW_SCHEMAS[name], fmt)
            for name in names or SHEETS}


def read_sheet(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.schema(schema).format(fmt).load(path)


def read_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """``root/<name>.parquet`` for every name."""
    return {name: read_parquet(spark, f"{root}/{name}.parquet") for name in names}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema the types are inferred by an extra pass."""
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.schema(schema).csv(path, header=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works on every file system the cluster knows."""
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException:
        return False
    return True


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a path, from their listing; their content is not read."""
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0


def resolve_input(spark: SparkSession, candidates: list[str],
                  required: list[str] | None = None, suffix: str = "") -> str:
    """First candidate holding every required table, else the first one that exists."""
    required = SHEETS if required is None else required
    for path in candidates:
        if all(path_exists(spark, f"{path}/{name}{suffix}") for name in required):
            return path
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"None of {candidates} exists")


def read_table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.read.table(name) if spark.catalog.tableExists(name) else None


def load_customer_mart(spark: SparkSession, build: Callable[[], DataFrame],
                       prefer_table: str | None = None) -> DataFrame:
    """The named table when it exists and has rows, else the frame built from joins."""
    if prefer_table is not None:
        stored = read_table_or_none(spark, prefer_table)
        if stored is not None and not stored.isEmpty():
            return stored
    return build()
