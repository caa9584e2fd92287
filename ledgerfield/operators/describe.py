"""Descriptive statistics of whole frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerfield.operators.aggregates import rows_from_one
from ledgerfield.operators.frames import numeric_columns
from ledgerfield.operators.quantiles import exact_quantiles, settled

PRODUCTS = ["n", "one", "square", "product"]


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max, nulls)."""
    columns = columns or numeric_columns(df)
    moments = _moments(df, columns)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]) \
        .withColumnRenamed("metric", "column")
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max", "nulls")


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[
        F.struct(
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
        ).alias(c) for c in columns])
    names = ["count", "mean", "std", "min", "max", "nulls"]
    return rows_from_one(one, [
        [("column", F.lit(c)), *[(n, F.col(f"`{c}`.{n}")) for n in names]] for c in columns])


def column_types(df: DataFrame) -> DataFrame:
    """(column, type) rows."""
    spark = df.sparkSession
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                 "column string, type string")


def distribution(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, median, std, min, max)."""
    columns = columns or numeric_columns(df)
    medians = exact_quantiles(df, columns, [0.5]).withColumnsRenamed(
        {"metric": "column", "q50": "median"})
    return _moments(df, columns).join(medians, "column", "left").select(
        "column", "mean", "median", "std", "min", "max")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) over pairs without nulls; null where a side does not vary.

    One pass makes the products of all pairs of columns at once (counts, sums, squares and products over
    the rows where both are present, taken from the column means), as matrices per task; tasks' rows are
    added up per column. Frames may be hundreds of columns wide.
    """
    columns = columns or numeric_columns(df)
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = np.array(numbers.agg(*[F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0))
                                   for c in numbers.columns]).first(), np.float64)
    width = len(columns)
    schema = "place int, " + ", ".join(f"{n} array<double>" for n in PRODUCTS)

    def rows_of(sums: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(places, pa.int32()), *[
            pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1, dtype=np.int32) * width),
                                     pa.array(part.ravel())) for part in sums]], ["place", *PRODUCTS])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(PRODUCTS), width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            there = ~np.isnan(x)
            x, there = np.where(there, x - means, 0.0), there.astype(float)
            total += [there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x]
        yield rows_of(total, np.arange(width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = np.stack([batch.column(n).flatten().to_numpy().reshape(-1, width) for n in PRODUCTS])
            for i, place in enumerate(batch.column("place").to_pylist()):
                total[place] = total.get(place, 0.0) + parts[:, i]
        if total:
            yield rows_of(np.stack(list(total.values()), axis=1), np.array(list(total)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = next(add(batches), None)
        if whole is None:
            return
        order = np.argsort(whole.column("place").to_numpy())
        n, one, square, product = (
            whole.column(c).flatten().to_numpy().reshape(-1, width)[order] for c in PRODUCTS)
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = square - one * one / n
            # What is left of a column without variation is rounding.
            spread = np.where(spread > 1e-13 * square, spread, np.nan)
            found = (product - one * one.T / n) / np.sqrt(spread * spread.T)
        names = np.array(columns, object)
        yield pa.record_batch([pa.array(np.repeat(names, width)), pa.array(np.tile(names, width)),
                               pa.array(found.ravel(), from_pandas=True)],
                              ["column_a", "column_b", "correlation"])

    sums = numbers.mapInArrow(multiply, schema).repartition("place").mapInArrow(add, schema)
    return sums.repartition(1).mapInArrow(finish, "column_a string, column_b string, correlation double")


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in equal-width bins 1..bins between the smallest and largest value (per group)."""
    by = by or []
    rows = df.na.drop(subset=[column, *by]).select(*by, F.col(column).cast("double").alias("v"))
    limits = rows.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    if by:
        # Few groups are broadcast by their known size; rows are binned before anything is shuffled.
        binned = rows.join(settled(limits), by)
    else:
        edge = limits.select(F.struct("low", "high")).scalar()
        binned = rows.withColumns({"low": edge.getField("low"), "high": edge.getField("high")})
    binned = binned.withColumn("bin", _bin(F.col("v"), F.col("low"), F.col("high"), bins))
    return binned.groupBy(*by, "bin").agg(
        F.count("*").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Right end of the last bin included; one bin holds everything when all values are equal."""
    position = F.floor(F.try_divide((value - low) * bins, high - low)).cast("int") + 1
    return F.least(F.coalesce(position, F.lit(1)), F.lit(bins))


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, empties, zeros) in one pass."""
    one = df.agg(*[F.struct(
        F.count_if(F.col(c).isNull()).alias("nulls"),
        F.count_if(F.col(c).cast("string") == "").alias("empties"),
        F.count_if(F.col(c).try_cast("double") == 0).alias("zeros"),
    ).alias(c) for c in columns])
    return rows_from_one(one, [
        [("column", F.lit(c)), ("nulls", F.col(f"{c}.nulls")), ("empties", F.col(f"{c}.empties")),
         ("zeros", F.col(f"{c}.zeros"))] for c in columns])


def row_and_column_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) for each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out
