"""Streams give the batch figures for every window the watermark has passed."""

from datetime import date, datetime, time, timedelta
from time import sleep
from uuid import uuid4

from pyspark.sql import functions as F

from ledgerfield.sources.scratch import scratch_path
from ledgerfield.streaming import windows


def _run(spark, folder, schema, build):
    name = f"test_{uuid4().hex}"
    path = scratch_path(spark, "test_streams", name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = windows.append_windows(build(stream), path, name)
    query.awaitTermination()
    return spark.read.parquet(path), query


def test_streams_agree_with_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = spark.range(0, 2000).select(
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 3 AS int))")
        .alias("ts"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))
        .alias("segment"),
        (F.col("id") % 40 == 0).alias("failed"), (F.col("id") % 700).cast("double").alias("ms"))
    for part in range(4):
        log.where(F.expr(f"ts >= timestamp'2024-01-0{part + 1} 00:00:00' AND "
                         f"ts < timestamp'2024-01-0{part + 2} 00:00:00'")) \
            .coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.parquet(folder)
    last = batch.agg(F.max("ts")).first()[0]
    builders = [
        (lambda df: windows.error_rate(df, "ts", "failed"), timedelta(minutes=15), timedelta(minutes=15)),
        (lambda df: windows.latency_p95(df, "ts", "ms"), timedelta(minutes=15), timedelta(minutes=15)),
        (lambda df: windows.daily_counts(df, "ts", "segment"), timedelta(days=1), timedelta(days=1)),
    ]
    for build, width, delay in builders:
        rows, query = _run(spark, folder, batch.schema, build)
        got = {tuple(r) for r in rows.collect()}
        # Every window that ends at or before the last watermark, and no other.
        start = lambda r: datetime.combine(r[0], time()) if isinstance(r[0], date) and not isinstance(
            r[0], datetime) else r[0]
        want = {tuple(r) for r in build(batch).collect() if start(r) + width <= last - delay}
        assert got == want and got and windows.late_rows(query) == 0
    assert windows.error_rate(batch, "ts", "failed").where("alert").count() > 0


def test_late_rows_are_counted(spark, tmp_path):
    folder = str(tmp_path / "log")
    schema = "ts timestamp, failed boolean"
    for rows in (["2024-01-01 00:01:00", "2024-01-01 09:00:00"], ["2024-01-01 10:00:00", "2024-01-01 00:02:00"],
                 ["2024-01-01 00:03:00", "2024-01-01 12:00:00"], ["2024-01-01 13:00:00"]):
        spark.createDataFrame([(r, True) for r in rows], "t string, failed boolean").select(
            F.to_timestamp("t").alias("ts"), "failed").coalesce(1).write.mode("append").parquet(folder)
        sleep(1.1)  # files are taken by their time
    rows, query = _run(spark, folder, schema, lambda df: windows.error_rate(df, "ts", "failed"))
    # 00:03 is dropped; 00:02 came one batch after the watermark had passed it and still counts.
    assert windows.late_rows(query) == 1
    assert rows.agg(F.sum("requests")).first()[0] + 1 + 1 == 7  # the last row's window is still open


def test_alerts_open_and_close_once(spark, tmp_path):
    """Neighbouring windows over the limit are one alert, on a stream as in a batch."""
    folder = str(tmp_path / "log")
    bad = {0, 1, 2, 5, 9, 10}
    log = spark.range(0, 40 * 60).select(
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id * 15 AS int))").alias("ts"),
        ((F.col("id") / 60).cast("int").isin(list(bad)) & (F.col("id") % 10 == 0)).alias("failed"))
    for part in range(4):
        log.where(F.expr(f"hour(ts) >= {part * 3} AND hour(ts) < {part * 3 + 3}")).coalesce(1).write.mode(
            "append").parquet(folder)
        sleep(1.1)
    want = [(0, 45, 3), (75, 90, 1), (135, 165, 2)]
    for found in (windows.alert_spans(spark.read.parquet(folder), "ts", "failed"),
                  _run(spark, folder, log.schema, lambda df: windows.alert_spans(df, "ts", "failed"))[0]):
        minutes = lambda t: int((t - datetime(2024, 1, 1)).total_seconds() // 60)
        assert sorted((minutes(r["opened"]), minutes(r["closed"]), r["windows"])
                      for r in found.collect()) == want
