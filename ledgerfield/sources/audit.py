"""Audit records of inputs and transformations. Rows are counted while the data is written."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, functions as F

INPUT_SCHEMA = ("input_id string, source string, name string, row_count bigint, "
                "column_count int, timestamp timestamp")
TRANSFORMATION_SCHEMA = (
    "transformation_id string, input_dataset string, output_dataset string, method string, "
    "parameters string, timestamp timestamp, rows_in bigint, rows_out bigint, "
    "columns_added array<string>")


def write_audited_input(df: DataFrame, source: str, name: str,
                        write: Callable[[DataFrame], object], audit_path: str) -> None:
    """Write the frame and append (source, name, row count, column count)."""
    counted = Observation()
    write(df.observe(counted, F.count(F.lit(1)).alias("rows")))
    row = (uuid4().hex[:8], source, name, counted.get["rows"], len(df.columns), _now())
    df.sparkSession.createDataFrame([row], INPUT_SCHEMA).coalesce(1) \
        .write.mode("append").parquet(audit_path)


def write_audited(df: DataFrame, transform: Callable[[DataFrame], DataFrame], method: str,
                  parameters: dict, names: tuple[str, str],
                  write: Callable[[DataFrame], object], audit_path: str) -> None:
    """Transform, write and append the rows in and out and the added columns.

    Both counts are observed during the one write, so nothing is scanned twice.
    """
    before, after = Observation(), Observation()
    out = transform(df.observe(before, F.count(F.lit(1)).alias("rows")))
    added = [c for c in out.columns if c not in df.columns]
    write(out.observe(after, F.count(F.lit(1)).alias("rows")))
    row = (uuid4().hex[:8], *names, method, json.dumps(parameters, sort_keys=True), _now(),
           before.get["rows"], after.get["rows"], added)
    df.sparkSession.createDataFrame([row], TRANSFORMATION_SCHEMA).coalesce(1) \
        .write.mode("append").parquet(audit_path)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
