"""Exact quantiles and ranks against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from ledgerfield.operators import quantiles


def skewed(n=6000, seed=3):
    """A third of all values equal, heavy tails on both sides, nulls, few and many groups."""
    rng = np.random.default_rng(seed)
    values = np.concatenate([
        np.full(n // 3, 42.0), rng.normal(0, 1e-3, n // 3), -np.exp(rng.normal(5, 4, n // 6)),
        np.exp(rng.normal(8, 6, n - 2 * (n // 3) - n // 6))])
    frame = pd.DataFrame({"v": values, "w": np.round(values), "g": rng.integers(0, 4, n)})
    frame.loc[frame.sample(frac=0.1, random_state=1).index, "v"] = None
    return frame


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_quantiles_per_group(spark):
    frame = skewed()
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(spark.createDataFrame(frame).repartition(7), ["v", "w"],
                                    probabilities, ["g"]).collect()
    assert len(got) == 8
    for row in got:
        want = frame[frame.g == row["g"]][row["metric"]].quantile(probabilities)
        assert close([row[c] for c in ("q0", "q25", "q50", "q75", "q99_9", "q100")], list(want))


def test_quantiles_of_small_frames(rows):
    df = rows([(1.0, None), (2.0, None), (9.0, 5.0)], "a double, b double")
    got = {r["metric"]: (r["q25"], r["q50"]) for r in
           quantiles.exact_quantiles(df, ["a", "b"], [0.25, 0.5]).collect()}
    assert got == {"a": (1.5, 2.0), "b": (5.0, 5.0)}
    empty = rows([], "a double")
    assert quantiles.exact_quantiles(empty, ["a"], [0.5]).count() == 0


def test_extreme_values(rows):
    values = [float("-inf"), -1e300, -1e-300, 0.0, 1e-300, 1e300, float("inf")]
    df = rows([(v,) for v in values] + [(float("nan"),)], "a double")
    got = quantiles.exact_quantiles(df, ["a"], [0.5]).first()
    assert got["q50"] == 0.0


def test_a_null_group_is_a_group(rows):
    data = [(g, float(i)) for g in (None, 1) for i in (1, 3, 8)]
    df = rows(data, "g int, v double")
    got = {r["g"]: r["q50"] for r in quantiles.exact_quantiles(df, ["v"], [0.5], ["g"]).collect()}
    assert got == {None: 3.0, 1: 3.0}


def test_many_groups(spark):
    df = spark.range(60_000).selectExpr("id % 20000 AS g", "cast(id * 7 % 1009 AS double) AS v")
    got = quantiles.exact_quantiles(df, ["v"], [0.5], ["g"]).toPandas().set_index("g").q50
    want = df.toPandas().groupby("g").v.median()
    assert len(got) == 20_000 and (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("start, step", [(0.5, 5e-9), (1e12, 1.0), (-3.0, 1e-7)])
@pytest.mark.parametrize("limit, cells", [(1 << 18, 4096), (500, 16)])
def test_a_narrow_band_in_one_or_many_rounds(spark, start, step, limit, cells, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    monkeypatch.setattr(quantiles, "CELLS", cells)
    frame = pd.DataFrame({"v": start + step * np.random.default_rng(1).permutation(50_000)})
    df = spark.createDataFrame(frame)
    got = quantiles.exact_quantiles(df, ["v"], [0.01, 0.5, 0.9]).first()
    assert close([got["q1"], got["q50"], got["q90"]], list(frame.v.quantile([0.01, 0.5, 0.9])))


@pytest.mark.parametrize("limit, local", [(100, 100_000), (100, 3), (1 << 18, 3)])
def test_hot_groups_are_narrowed_and_brackets_may_be_many(spark, limit, local, monkeypatch):
    """A group with a third of all rows, small ones and a null one; brackets fetched or written."""
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    monkeypatch.setattr(quantiles, "CELLS", 8)
    monkeypatch.setattr(quantiles, "LOCAL_ROWS", local)
    frame = skewed(3000)
    frame["g"] = np.where(np.arange(3000) % 3 == 0, "hot", "g" + (frame.g * 37 + frame.index % 11).astype(str))
    frame.loc[frame.index % 50 == 1, "g"] = None
    got = quantiles.exact_quantiles(spark.createDataFrame(frame).repartition(4), ["v", "w"],
                                    [0.0, 0.3, 1.0], ["g"]).collect()
    want = {(g, m): list(part[m].quantile([0.0, 0.3, 1.0])) for g, part in frame.groupby("g", dropna=False)
            for m in ("v", "w") if part[m].notna().any()}
    assert len(got) == len(want)
    for r in got:
        key = r["g"] if r["g"] is not None else next(g for g, _ in want if g != g or g is None)
        assert close([r["q0"], r["q30"], r["q100"]], next(
            v for (g, m), v in want.items() if m == r["metric"] and (g == key or g is key)))


def test_infinities_and_zeros_at_the_ends(rows):
    df = rows([(v,) for v in (float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1e308, -1e308)], "a double")
    got = quantiles.exact_quantiles(df, ["a"], [0.0, 0.5, 2 / 3, 5 / 6, 1.0]).first()
    assert list(got)[1:] == [float("-inf"), 0.0, 5e-324, 1e308, float("inf")]


def test_no_row_is_shuffled_before_it_is_counted(spark, monkeypatch):
    """Below every exchange of the narrowing there is an aggregate of the rows."""
    plans = []
    monkeypatch.setattr(quantiles, "LIMIT", 100)
    own = quantiles.settled

    def spied(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, *args)

    monkeypatch.setattr(quantiles, "settled", spied)
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 AS double) AS v", "id % 2 AS g")
    quantiles.exact_quantiles(df, ["v"], [0.5], ["g"]).collect()
    assert len(plans) > 2
    for plan in plans:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                assert any("HashAggregate" in below for below in lines[i + 1:]), plan
                assert "Range (" not in lines[i + 1] and "Join" not in lines[i + 1], plan


def test_ranks_over_range_partitions(spark):
    frame = pd.DataFrame({"v": 0.5 + 5e-9 * np.random.default_rng(1).permutation(50_000)})
    ranks = quantiles.value_ranks(spark.createDataFrame(frame), "v").toPandas().sort_values("value")
    assert (ranks.average_rank.to_numpy() == np.arange(1, len(ranks) + 1)).all()


def test_percent_rank_averages_ties(spark):
    frame = skewed(3000)
    df = quantiles.percent_rank_average(spark.createDataFrame(frame).repartition(5), "v", "p")
    got = df.toPandas().sort_values(["v", "w", "g"])
    want = frame.assign(p=frame.v.rank(pct=True)).sort_values(["v", "w", "g"])
    assert len(got) == len(frame)
    np.testing.assert_allclose(got.p.to_numpy(), want.p.to_numpy(), rtol=1e-12)


def test_auc_by_brute_force(spark):
    rng = np.random.default_rng(0)
    score = np.round(rng.random(300), 2)
    label = (rng.random(300) < score).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": label, "s": score}))
    pairs = score[label == 1][:, None] - score[label == 0][None, :]
    want = ((pairs > 0) + 0.5 * (pairs == 0)).mean()
    got = df.limit(1).select(quantiles.roc_auc(df, "y", "s").alias("a")).first()["a"]
    assert close(got, want)


def test_deciles_keep_equal_values_together(spark):
    frame = skewed(2000).dropna()
    got = quantiles.decile_of(spark.createDataFrame(frame), "v").toPandas()
    edges = frame.v.quantile([i / 10 for i in range(1, 10)]).to_numpy()
    want = (edges[None, :] < got.v.to_numpy()[:, None]).sum(axis=1) + 1
    assert (got.decile.to_numpy() == want).all()
    assert got.groupby("v").decile.nunique().max() == 1
