"""Drift and stability checks of a deployed segmentation (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerfield.functions.dates import month_start
from ledgerfield.operators.joins import attach_group_values
from ledgerfield.operators.quantiles import exact_quantiles, medians_by, melt
from ledgerfield.plans.sweep import stability

PSI_FLOOR = 1e-4
PSI_ALERT = 0.2
PSI_BREACHES_TO_RETRAIN = 3


def population_stability(baseline: DataFrame, current: DataFrame, columns: list[str],
                         bins: int = 10) -> DataFrame:
    """(metric, psi, breach): shares per baseline quantile bin in both frames.

    Bin counts are combined before the shuffle; the edges are one array per column.
    """
    probabilities = [i / bins for i in range(1, bins)]
    quantiles = exact_quantiles(baseline, columns, probabilities)
    edge_names = quantiles.columns[1:]
    edges = quantiles.select(F.map_from_entries(F.collect_list(
        F.struct("metric", F.array(*edge_names).alias("edges"))))).scalar()

    def counted(df: DataFrame, side: str) -> DataFrame:
        rows = melt(df, columns, []).withColumn("edges", F.try_element_at(edges, F.col("metric")))
        rows = rows.select("metric", _bin(F.col("value")).alias("bin"))
        return rows.groupBy("metric", "bin").agg(F.count("*").alias("n")) \
            .withColumn("side", F.lit(side))

    both = counted(baseline, "baseline").unionByName(counted(current, "current"))
    wide = both.groupBy("metric", "bin").agg(
        F.sum(F.when(F.col("side") == "baseline", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("side") == "current", F.col("n")).otherwise(0)).alias("b"))
    group = Window.partitionBy("metric")
    share = lambda c: F.greatest(
        F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(group)), F.lit(0.0)),
        F.lit(PSI_FLOOR))
    parts = wide.select("metric", share("a").alias("a"), share("b").alias("b"))
    psi = parts.groupBy("metric").agg(
        F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("psi"))
    return psi.withColumn("breach", F.col("psi") > PSI_ALERT)


def _bin(value: Column) -> Column:
    return F.size(F.filter(F.col("edges"), lambda e: e < value))


def retrain_needed(psi: DataFrame) -> DataFrame:
    return psi.agg(F.count_if("breach").alias("breaches")).select(
        "breaches", (F.col("breaches") >= PSI_BREACHES_TO_RETRAIN).alias("retrain"))


def daily_segment_counts(df: DataFrame, moment: str, segment: str) -> DataFrame:
    return df.groupBy(F.to_date(moment).alias("day"), F.col(segment).alias("segment")).agg(
        F.count("*").alias("customers"))


def segment_share_shift(daily: DataFrame, days: int = 30, limit: float = 0.15) -> DataFrame:
    """Relative change of a segment's daily share against the share some days earlier."""
    totals = daily.groupBy("day").agg(F.sum("customers").alias("total"))
    shares = daily.join(totals, "day").select(
        "day", "segment", (F.col("customers") / F.col("total")).alias("share"))
    earlier = shares.select(F.date_add("day", days).alias("day"), "segment",
                            F.col("share").alias("share_before"))
    change = F.try_divide(F.col("share") - F.col("share_before"), F.col("share_before"))
    return shares.join(earlier, ["day", "segment"]).withColumn("shift", change) \
        .withColumn("alert", F.abs("shift") > limit)


def silhouette_drop(previous: DataFrame, refreshed: DataFrame, limit: float = 0.10) -> DataFrame:
    """Compare the chosen k's silhouette on two model cards."""
    def chosen(card: DataFrame) -> Column:
        row = F.filter("k_evaluation", lambda r: r["k"] == F.col("n_clusters"))
        return card.select(row[0]["silhouette"].alias("s")).scalar()

    values = refreshed.select(chosen(previous).alias("before"), chosen(refreshed).alias("after"))
    drop = F.try_divide(F.col("before") - F.col("after"), F.abs("before"))
    return values.withColumn("drop", drop).withColumn("alert", F.col("drop") > limit)


def roll_rates(snapshots: DataFrame, account: str, month: str, days_past_due: str) -> DataFrame:
    """Moves between 0, 30, 60 and 90 day buckets from one monthly snapshot to the next.

    An account with several snapshots in a month counts once, at its worst. The next month is found by a
    join on (account, month), so no account is sorted in one task.
    """
    snapshots = snapshots.groupBy(F.col(account).alias("account"), month_start(F.col(month)).alias(
        "month")).agg(F.max(days_past_due).alias("dpd"))
    dpd = F.col("dpd")
    bucket = F.when(dpd >= 90, "90+").when(dpd >= 60, "60-89").when(dpd >= 30, "30-59") \
        .otherwise("0-29")
    now = snapshots.select("account", "month", bucket.alias("from_bucket"))
    after = now.select("account", F.add_months("month", -1).alias("month"),
                       F.col("from_bucket").alias("to_bucket"))
    moves = now.join(after, ["account", "month"]).groupBy("from_bucket", "to_bucket").agg(
        F.count("*").alias("accounts"))
    total = F.sum("accounts").over(Window.partitionBy("from_bucket"))
    return moves.withColumn("rate", F.col("accounts") / total)


def fill_median_by_group(df: DataFrame, column: str, group: str) -> DataFrame:
    """Nulls get the exact median of their group, however large the group is."""
    middle = medians_by(df.na.drop(subset=[group]), [group], [column])
    joined = attach_group_values(df, middle.withColumnRenamed(column, "__median"), group)
    return joined.withColumn(column, F.coalesce(F.col(column).cast("double"), "__median")) \
        .drop("__median")


def adjusted_rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings of the same rows, from their contingency counts."""
    choose2 = lambda c: c * (c - 1) / 2.0
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))

    def over(keys: list[str]) -> Column:
        sums = cells.groupBy(*keys).agg(F.sum("n").alias("m"))
        return sums.select(F.sum(choose2(F.col("m")))).scalar()

    total = cells.agg(F.sum(choose2(F.col("n"))).alias("index"),
                      choose2(F.sum("n")).alias("all"))
    rows, columns = over([a]), over([b])
    expected = rows * columns / F.col("all")
    ari = F.try_divide(F.col("index") - expected, (rows + columns) / 2.0 - expected)
    return total.select(F.coalesce(ari, F.lit(1.0)).alias("adjusted_rand_index"))


def segmentation_stability(vectors: DataFrame, k: int, ids: list[str], replicates: int = 20,
                           features: str = "features") -> DataFrame:
    """(replicates, mean, p10, p50, p90) of the agreement with models of resampled rows."""
    agreement = stability(vectors, k, ids, replicates, features)
    # One row per replicate.
    return agreement.agg(
        F.count("*").alias("replicates"), F.avg("adjusted_rand_index").alias("mean"),
        *[F.percentile("adjusted_rand_index", p / 100).alias(f"p{p}") for p in (10, 50, 90)])


def overrides_by_month(overrides: DataFrame) -> DataFrame:
    """Human overrides of model decisions per month and reason."""
    changed = overrides.where(~F.col("model_segment").eqNullSafe(F.col("human_decision")))
    return changed.groupBy(month_start(F.col("timestamp")).alias("month"), "reason_code").agg(
        F.count("*").alias("overrides"))
