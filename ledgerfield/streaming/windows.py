"""Windowed figures of segment and request logs.

Each function takes a batch or a streaming frame. On a stream the watermark bounds the state: windows
older than it are emitted and dropped. State is one aggregate per window and key, never the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfield.operators.quantiles import exact_quantiles
from ledgerfield.sources.scratch import checkpoint_root

SKETCH = 400  # size of a sketch; its ranks are off by 0.7 % at most


def _late(df: DataFrame, moment: str, delay: str) -> DataFrame:
    return df.withWatermark(moment, delay) if df.isStreaming else df


def daily_counts(df: DataFrame, moment: str, segment: str, delay: str = "1 day") -> DataFrame:
    """Rows per day and segment."""
    counts = _late(df, moment, delay).groupBy(
        F.window(moment, "1 day").alias("w"), F.col(segment).alias("segment")).agg(
        F.count("*").alias("customers"))
    return counts.select(F.col("w.start").cast("date").alias("day"), "segment", "customers")


def rank_error(k: int) -> float:
    """By how much the rank of a sketch's quantile is off at most, as a share (99 % of all sketches)."""
    return 2.296 / k ** 0.9723


def latency_p95(df: DataFrame, moment: str, latency: str, width: str = "15 minutes",
                limit: float = 500.0, delay: str = "15 minutes", k: int = SKETCH) -> DataFrame:
    """95th percentile of request latency per window with the bounds it is known within.

    The state of a window is one mergeable sketch of bounded size; ``low`` and ``high`` are its quantiles
    a rank error below and above. ``exact_latency_p95`` answers for batches.
    """
    windows = _late(df, moment, delay).where(F.col(latency).isNotNull()).groupBy(
        F.window(moment, width).alias("w")).agg(
        F.kll_sketch_agg_double(F.col(latency).cast("double"), F.lit(k)).alias("sketch"),
        F.count("*").alias("requests"))
    error = rank_error(k)
    at = lambda rank: F.kll_sketch_get_quantile_double("sketch", F.lit(rank))
    return windows.select(
        F.col("w.start").alias("window_start"), at(0.95).alias("p95"), at(0.95 - error).alias("low"),
        at(min(1.0, 0.95 + error)).alias("high"), "requests").withColumn("alert", F.col("p95") > limit)


def exact_latency_p95(df: DataFrame, moment: str, latency: str, width: str = "15 minutes",
                      limit: float = 500.0) -> DataFrame:
    """The exact 95th percentile (interpolated) per window of a batch, in two passes."""
    rows = df.withColumn("window_start", F.window(moment, width)["start"])
    found = exact_quantiles(rows, [latency], [0.95], ["window_start"]).select(
        "window_start", F.col("q95").alias("p95"))
    counts = rows.groupBy("window_start").agg(F.count(latency).alias("requests"))
    return counts.join(found, "window_start").withColumn("alert", F.col("p95") > limit)


def error_rate(df: DataFrame, moment: str, failed: str, width: str = "15 minutes",
               limit: float = 0.01, delay: str = "15 minutes") -> DataFrame:
    """Share of failed requests per window."""
    windows = _late(df, moment, delay).groupBy(F.window(moment, width).alias("w")).agg(
        F.avg(F.col(failed).cast("int")).alias("error_rate"), F.count("*").alias("requests"))
    return windows.select(F.col("w.start").alias("window_start"), "error_rate", "requests",
                          (F.col("error_rate") > limit).alias("alert"))


def alert_spans(df: DataFrame, moment: str, failed: str, width: str = "15 minutes",
                limit: float = 0.01, delay: str = "15 minutes") -> DataFrame:
    """(opened, closed, windows, requests, worst_rate): one row per alert.

    An alert opens with the first window over the limit and closes with the last one in a row; a window
    within the limit, or without requests, ends it. On a stream both steps keep their state behind the
    watermark, so an alert is given once, when it can no longer go on.
    """
    windows = _late(df, moment, delay).groupBy(F.window(moment, width).alias("w")).agg(
        F.avg(F.col(failed).cast("int")).alias("rate"), F.count("*").alias("n"))
    over = windows.where(F.col("rate") > limit).select(F.window_time("w").alias("at"), "w", "rate", "n")
    # Ends of neighbouring windows are one width apart; the gap is a little more than that.
    # Streams want a key beside a session; always 0, but not a constant that the optimizer would drop.
    one = F.pmod("n", F.lit(1)).alias("one")
    spans = over.groupBy(F.session_window("at", f"{width} 1 second").alias("s"), one).agg(
        F.min("w.start").alias("opened"), F.max("w.end").alias("closed"), F.count("*").alias("windows"),
        F.sum("n").alias("requests"), F.max("rate").alias("worst_rate"))
    return spans.drop("s", "one")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, over all batches of the query so far.

    Spark drops rows behind the watermark of the batch before; a row that is late by less is counted in.
    """
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for operator in progress["stateOperators"][:1])


def append_windows(stream: DataFrame, path: str, name: str) -> StreamingQuery:
    """Write what is available now to parquet and stop.

    Appends every window once, when the watermark has passed it, so a restarted query continues
    where it was: offsets and state are kept below the cluster's checkpoint folder.
    """
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{checkpoint_root(stream.sparkSession)}/streams/{name}")
        .queryName(name)
        .trigger(availableNow=True)
        .start()
    )
