"""Joins, aggregates, windows and checks on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerfield.operators import aggregates, describe, frames, joins, ordering, quality


def test_left_lookup_keeps_all_matches_and_null_keys(rows):
    left = rows([(1, "a"), (2, None), (3, "z"), (4, "a")], "id int, k string")
    right = rows([("a", 10), ("a", 11), (None, 12), ("b", 13)], "k2 string, v int")
    want = [(1, 10), (1, 11), (2, None), (3, None), (4, 10), (4, 11)]
    for spread in (None, "id"):
        got = joins.left_lookup(left, right, [("k", "k2")], spread).orderBy("id", "v")
        assert got.columns == ["id", "k", "v"]
        assert [(r["id"], r["v"]) for r in got.collect()] == want


def test_null_keys_are_spread_over_tasks(spark):
    """Without broadcast, rows with a null key must not share one partition."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(4000).select("id", F.lit(None).cast("bigint").alias("k"))
        left = left.unionByName(spark.range(100).select((F.col("id") + 9000).alias("id"),
                                                        F.col("id").alias("k")))
        right = spark.range(100).select(F.col("id").alias("k2"), F.col("id").alias("v"))

        def largest(df):
            sizes = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            return sizes

        spread = joins.left_lookup(left, right, [("k", "k2")], "id")
        assert spread.count() == 4100 and spread.where("v IS NOT NULL").count() == 100
        assert largest(spread) < 1500
        assert largest(joins.left_lookup(left, right, [("k", "k2")])) >= 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_one_per_key_has_an_explicit_order(rows):
    df = rows([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q"), (None, 5, "n")],
              "k string, o int, v string")
    got = {r["k"]: (r["o"], r["v"]) for r in joins.one_per_key(df, "k", ["o"]).collect()}
    assert got == {"a": (1, "y"), "b": (None, "q"), None: (5, "n")}


def test_anti_joins_ignore_null_keys(rows):
    left = rows([(1,), (2,), (None,)], "k int")
    right = rows([(1,), (None,)], "k2 int")
    got = {r["k"] for r in joins.without_match(left, right, "k", "k2").collect()}
    assert got == {2, None}
    flags = {r["k"]: r["hit"] for r in joins.flag_members(left, right, "k", "k2", "hit").collect()}
    assert flags == {1: 1, 2: 0, None: 0}


def test_modes_weights_and_firsts(rows):
    df = rows([("c", 1, "b", 0.0, 1.0), ("c", 2, "a", 0.0, 0.0), ("c", 3, None, 3.0, 0.5),
               ("d", 1, None, 2.0, 0.25)],
              "c string, o int, m string, w double, p double")
    modes = {r["c"]: r["m"] for r in aggregates.modes_by(df, ["c"], {"m": "none"}).collect()}
    assert modes == {"c": "a", "d": "none"}
    got = {r["c"]: r for r in df.groupBy("c").agg(
        aggregates.weighted_mean("p", "w").alias("p"),
        aggregates.first_present("m", F.col("o")).alias("f")).collect()}
    # Zero weights count 1: (1 * 1 + 0 * 1 + 0.5 * 3) / 5.
    assert (got["c"]["p"], got["c"]["f"]) == (0.5, "b")
    assert (got["d"]["p"], got["d"]["f"]) == (0.25, None)


def test_modes_of_a_hot_group_and_a_null_group(spark):
    df = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, 'g' || id % 5)) AS g",
        "if(id = 6, '-1', cast(id as string)) AS a", "id % 4 AS b").unionByName(
        spark.createDataFrame([("hot", "12", 9), ("e", None, None)], "g string, a string, b long"))
    got = {r["g"]: (r["a"], r["b"]) for r in aggregates.modes_by(df, ["g"], {"a": None, "b": "no"}).collect()}
    assert got["hot"] == ("12", "0") and got["e"] == (None, "no") and got[None][0] is not None
    want = df.where("g = 'g1'").toPandas()
    best = want.groupby("b").size()
    assert got["g1"][1] == str(min(best[best == best.max()].index))


def test_distinct_counts_dense_sparse_and_text(spark):
    df = spark.range(5000).selectExpr(
        "if(id % 3 = 0, null, id % 2) AS g", "id % 700 - 350 AS dense", "id * 1000003 * 1000003 AS sparse",
        "cast(id % 11 as string) AS word", "if(id % 2 = 0, id % 5, null) AS holes", "id % 8 / 4 AS half")
    columns = ["dense", "sparse", "word", "holes", "half"]
    counted = aggregates.distinct_counts(df, ["g"], columns)
    want = df.toPandas().groupby("g", dropna=False)[columns].nunique()
    for r in counted.collect():
        own = want[want.index.isna()] if r["g"] is None else want.loc[[r["g"]]]
        assert [r[c] for c in columns] == own.iloc[0].tolist()
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()
    assert aggregates.distinct_counts(df.limit(0), ["g"], columns).count() == 0


def test_correlations_of_wide_frames_with_nulls(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(400, 120)) + 1e6, columns=[f"v.{i}" for i in range(120)])
    frame = frame.mask(rng.random(frame.shape) < 0.2)
    frame["v.3"], frame["v.5"] = 7.0, np.nan
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None),
                               ", ".join(f"`{c}` double" for c in frame.columns)).repartition(5)
    df = df.toDF(*[c.replace(".", "_") for c in frame.columns])
    got = describe.correlations(df).toPandas().pivot(
        index="column_a", columns="column_b", values="correlation")
    names = [c.replace(".", "_") for c in frame.columns]
    np.testing.assert_allclose(got.loc[names, names].to_numpy(dtype=float), frame.corr().to_numpy(),
                               rtol=1e-7, atol=1e-9)
    empty = describe.correlations(df.limit(0).select("v_1", "v_2")).collect()
    assert [r["correlation"] for r in empty] in ([None] * 4, [])


def test_pivot_of_unlisted_values(rows):
    df = rows([(1, "a", 2), (1, "b", 3), (2, "c", 4), (2, None, 5)], "q int, k string, n int")
    with pytest.raises(Exception, match="not among the columns listed"):
        aggregates.pivot_values(df, "q", "k", ["a", "b"], F.sum("n")).collect()
    other = aggregates.pivot_values(df, "q", "k", ["a"], F.sum("n"), 0, others="rest").orderBy("q").collect()
    assert [(r["a"], r["rest"]) for r in other] == [(2, 3), (0, 4)]
    assert aggregates.pivot_values(df, "q", "k", None, F.sum("n")).columns == ["q", "a", "b", "c"]


def test_growth_over_gaps_and_zero_bases(rows):
    df = rows([("k", 1, 10), ("k", 3, 15), ("u", 2, 5)], "c string, q int, n int")
    sparse = ordering.percent_change(df, "c", ["q"], "n", "g").collect()
    assert [(r["c"], r["q"], r["g"]) for r in sparse] == [("k", 3, 50.0)]
    wide = aggregates.pivot_values(df, "q", "c", ["k", "u"], F.sum("n"), 0)
    dense = ordering.percent_change_down(wide, "q", ["k", "u"]).orderBy("q").collect()
    assert [r["k_growth_pct"] for r in dense] == [None, -100.0, None]
    assert [r["u_growth_pct"] for r in dense] == [None, None, -100.0]


def test_rolling_mean_starts_short(rows):
    df = rows([("a", m, m * 1.0) for m in range(1, 6)], "g string, m int, v double")
    got = ordering.rolling_mean(df, "g", "m", "v", 3, "r").orderBy("m").collect()
    assert [r["r"] for r in got] == [1.0, 1.5, 2.0, 3.0, 4.0]


def test_histogram_holds_every_value(rows):
    df = rows([(float(v),) for v in (0, 1, 5, 9, 10, 10)] + [(None,)], "v double")
    got = {r["bin"]: r["count"] for r in describe.histogram(df, "v", 10).collect()}
    assert got == {1: 1, 2: 1, 6: 1, 10: 3}
    same = rows([(7.0,), (7.0,)], "v double")
    assert [(r["bin"], r["count"]) for r in describe.histogram(same, "v", 5).collect()] == [(1, 2)]


def test_limits_are_held(rows):
    df = rows([(i,) for i in range(60)], "i int")
    assert [ordering.sample_rows(df, ["i"], n).count() for n in (-3, 0, 20, 500)] == [1, 1, 20, 50]


def test_top_two_takes_eligible_rows_first(rows):
    df = rows([(1, 0.9, False), (2, 0.5, True), (3, 0.8, False), (4, 0.8, False)],
              "segment_id int, score double, ok boolean")
    pick = lambda d: [r["segment_id"] for r in ordering.top_two_with_filler(
        d, F.col("ok"), "score", "segment_id").collect()]
    assert pick(df) == [2, 1]
    assert pick(df.withColumn("ok", F.lit(False))) == [1, 3]
    assert pick(df.where("segment_id = 4")) == [4]


def test_headers_fills_and_filters(rows):
    df = rows([(1, "Kenya"), (None, None)], "` Age ` int, `Home Town` string")
    clean = frames.clean_headers(df)
    assert clean.columns == ["age", "home_town"]
    assert [r["age"] for r in frames.fill_median(clean, "age").collect()] == [1.0, 1.0]
    assert frames.fill_median(clean, "income") is clean
    assert frames.equals_ignoring_case(clean, "home_town", " KENYA ").count() == 1
    assert frames.equals_ignoring_case(clean, "home_town", None).count() == 2
    assert frames.matches_pattern(clean, "home_town", "^k.*A$").count() == 1
    assert frames.keep_existing(clean, ["age", "height"]).columns == ["age"]


def test_checks_report_and_do_not_raise(rows):
    df = rows([(1, 1, 0.5, "c"), (1, 2, 1.5, ""), (None, 0, None, "d")],
              "id int, flag int, score double, owner string")
    report = quality.run_checks(df, [
        quality.not_null("id"), quality.unique("id"), quality.in_values("flag", [0, 1]),
        quality.in_range("score", 0, 1), quality.not_negative("score"),
        quality.not_empty_text("owner")])
    got = [(r["severity"], r["violations"], r["passed"]) for r in report.collect()]
    assert got == [("error", 1, False), ("error", 2, False), ("error", 1, False),
                   ("error", 2, False), ("error", 0, True), ("warn", 1, False)]
    assert not quality.passes(report)
    assert quality.passes(quality.run_checks(df, [quality.not_empty_text("owner")]))


def test_required_columns_and_nulls_raise(rows):
    df = rows([(1, None)], "customer_id int, age int")
    assert quality.require_columns(df, ["customer_id", "age"])
    with pytest.raises(quality.ValidationError, match="income"):
        quality.require_columns(df, ["income"])
    assert quality.require_no_nulls(df, ["customer_id"])
    with pytest.raises(quality.ValidationError, match="age"):
        quality.require_no_nulls(df, ["customer_id", "age"])


def test_lookup_neither_shuffles_a_grouped_side_again_nor_matches_missing_keys(spark, rows):
    from ledgerfield.operators import joins

    left = rows([("a", "x"), ("b", None), ("c", "z"), (None, None)], "id string, k string")
    right = joins.one_per_key(rows([("x", 1), ("x", 2), ("\0b", 3), (None, 4)], "k string, v int"), "k", ["v"])
    got = joins.left_lookup(left, right, [("k", "k")], "id")
    assert {tuple(r) for r in got.collect()} == {("a", "x", 1), ("b", None, None), ("c", "z", None), (None, None, None)}
    joined = joins.left_lookup(left, right.hint("merge"), [("k", "k")], "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2
