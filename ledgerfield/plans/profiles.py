"""How segments differ, and what they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerfield import constants as K
from ledgerfield.functions.money import segment_name
from ledgerfield.functions.numbers import round_even
from ledgerfield.operators.quantiles import medians_by


def profile_segments(df: DataFrame, label: str = "segment_id") -> DataFrame:
    """Mean, median and count of every profile metric, plus size and share, per segment."""
    rows = df.na.drop(subset=[label])
    metrics = [c for c in K.PROFILE_METRICS if c in df.columns]
    total = df.select(F.count("*")).scalar()
    means = rows.groupBy(label).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in metrics],
        *[F.count(c).alias(f"{c}_count") for c in metrics],
        F.count("*").alias("customer_count"),
    ).withColumn("pct_of_customers", round_even(F.col("customer_count") * 100.0 / total, 1))
    medians = medians_by(rows, [label], metrics).withColumnsRenamed({c: f"{c}_median" for c in metrics})
    columns = [f"{c}_{part}" for c in metrics for part in ("mean", "median", "count")]
    return means.join(medians, label, "left").select(
        label, *columns, "customer_count", "pct_of_customers")


def segment_lifts(df: DataFrame, label: str = "segment_id") -> DataFrame:
    """Mean of every metric per segment and its lift against the portfolio (0 for a mean of 0)."""
    metrics = [c for c in K.PROFILE_METRICS if c in df.columns]
    portfolio = df.select(F.struct(*[F.avg(c).alias(c) for c in metrics])).scalar()
    means = df.na.drop(subset=[label]).groupBy(F.col(label).alias("segment_id")).agg(
        F.count("*").alias("size"), *[F.avg(c).alias(f"{c}_mean") for c in metrics])
    lifts = {}
    for c in metrics:
        lift = F.try_divide(F.col(f"{c}_mean"), portfolio.getField(c)) - 1
        lifts[f"{c}_lift"] = F.when(portfolio.getField(c) == 0, 0.0).otherwise(lift)
    columns = [f"{c}_{part}" for c in metrics for part in ("mean", "lift")]
    return means.withColumns(lifts).select("segment_id", "size", *columns)


def name_segments(lifts: DataFrame) -> DataFrame:
    """(segment_id, segment_name). Names need not be unique. The median spans the segments.

    A metric that was not profiled counts as 0, the repayment progress as a half.
    """
    missing = {"is_default_mean": 0.0, "is_in_arrears_mean": 0.0, "repayment_progress_mean": 0.5,
               "financed_amount_mean": 0.0}
    lifts = lifts.withColumns({c: F.lit(v) for c, v in missing.items() if c not in lifts.columns})
    financed_median = lifts.select(F.median("financed_amount_mean")).scalar()
    return lifts.select("segment_id", segment_name(
        *[F.col(c) for c in missing], financed_median).alias("segment_name"))
