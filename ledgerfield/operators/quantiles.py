"""Exact quantiles and ranks without bringing a column, or a group, into one task.

Quantiles are found by narrowing. A histogram (count, least and greatest value of every cell) is combined
before the shuffle; the cells that hold the wanted ranks become the brackets of the next round and are
split into cells between their own least and greatest value, until a bracket holds at most ``LIMIT``
rows, which are then counted by value. So cells follow the data, no row is shuffled by column or group,
and the largest window spans ``CELLS`` cells or ``LIMIT`` values, whatever the size of the column.

Nothing is sampled and no answer is approximate. Brackets (one per group, column and wanted rank) are
fetched between rounds while they are few and broadcast by their known size; beyond ``LOCAL_ROWS`` they
are written and joined. The frame is scanned once per round, two or three times as a rule: hand over a
written or persisted one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerfield.sources.scratch import scratch_path

LIMIT = 1 << 18  # rows of a group or bracket that are counted by value
CELLS = 4096  # of a bracket
OCTAVE = 8  # cells of the first round for each power of two
LOCAL_ROWS = 100_000


def settled(df: DataFrame, local_rows: int | None = None) -> DataFrame:
    """The frame, computed once: as local rows while they are few, else as a written table."""
    spark = df.sparkSession
    most = LOCAL_ROWS if local_rows is None else local_rows
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        return spark.createDataFrame(rows, df.schema)
    return stored(df)


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table written to the shared folder."""
    path = scratch_path(df.sparkSession, "operators", uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def melt(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., metric, value) rows without nulls and NaN."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(*by, F.inline(pairs)).where("value IS NOT NULL AND NOT isnan(value)")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    by: list[str] | None = None) -> DataFrame:
    """Interpolated quantiles, one row per group and column: (by..., metric, q<percent>...).

    A null in ``by`` is a group like any other; a group without values has no row. Groups of up to
    ``LIMIT`` rows are counted by value at once, larger ones by narrowing.
    """
    by = by or []
    rows, keys = melt(df, columns, by), [*by, "metric"]
    found, large = [], rows
    if by:
        totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
        hot = settled(totals.where(F.col("total") > LIMIT).select(*keys))
        if hot.isEmpty():
            small, large = rows, None
        else:
            small = rows.join(_named(hot, keys), _same(rows, keys), "left_anti")
            large = rows.join(_named(hot, keys), _same(rows, keys), "left_semi")
        found.append(_by_value(small, keys, probabilities))
    if large is not None:
        found += _narrowed(large, keys, probabilities)
    held = reduce(DataFrame.unionByName, found)
    parts = held.select(*keys, "value", F.inline("targets"))
    return parts.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("p") == p, F.col("value") * F.col("weight"))).alias(_name(p))
        for p in probabilities])


def medians(df: DataFrame, columns: list[str]) -> Column:
    """Medians of whole columns as a struct, null for a column without values; one row is fetched."""
    found = exact_quantiles(df, columns, [0.5])
    return found.agg(F.struct(*[
        F.max(F.when(F.col("metric") == c, F.col("q50"))).alias(c) for c in columns])).scalar()


def medians_by(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., columns...): median of each column per group with a value in one of them."""
    return exact_quantiles(df, columns, [0.5], by).groupBy(*by).agg(*[
        F.max(F.when(F.col("metric") == c, F.col("q50"))).alias(c) for c in columns])


def _name(p: float) -> str:
    return f"q{p * 100:g}".replace(".", "_")


def _named(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__{k}" for k in keys})


def _same(rows: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"__{k}")) for k in keys])


def _by_value(rows: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """(keys..., value, targets) of groups of bounded size."""
    counts = rows.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    held = _held(counts, keys, "value", _targets(probabilities, _total(keys)))
    return held.select(*keys, "value", "targets")


def _narrowed(rows: DataFrame, keys: list[str], probabilities: list[float]) -> list[DataFrame]:
    """(keys..., value, targets) frames of groups of any size."""
    edges = [F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")]
    cells = rows.groupBy(*keys, _magnitude(F.col("value")).alias("cell")).agg(*edges)
    found, cells = [], _held(cells, keys, "cell", _targets(probabilities, _total(keys)))
    while True:
        brackets = settled(cells.select(*keys, "low", "high", "n", "targets"))
        found.append(brackets.where("low = high").select(*keys, F.col("low").alias("value"), "targets"))
        brackets = brackets.where("low < high")
        most = brackets.agg(F.max("n")).first()[0]
        if most is None:
            return found
        cell = F.col("value") if most <= LIMIT else _linear(
            F.col("value"), F.col("__low"), F.col("__high"))
        # Brackets of a group do not overlap: each row is in one at most.
        inside = rows.join(_named(brackets.select(*keys, "low", "high"), [*keys, "low", "high"]),
                           _same(rows, keys) & F.col("value").between(F.col("__low"), F.col("__high")))
        cells = inside.groupBy(*keys, F.col("__low").alias("bracket"), cell.alias("cell")).agg(*edges)
        wanted = _named(brackets.select(*keys, F.col("low").alias("bracket"), "targets"),
                        [*keys, "bracket"])
        cells = cells.join(wanted, _same(cells, [*keys, "bracket"]))
        cells = _held(cells, [*keys, "bracket"], "cell", F.col("targets"))


def _magnitude(value: Column) -> Column:
    """Cell of a value by sign and size: so many to a power of two, rising with the value."""
    size = F.floor(F.least((F.log2(F.abs(value)) + 1100) * OCTAVE, F.lit(1e6)))
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * size)


def _linear(value: Column, low: Column, high: Column) -> Column:
    share = (value - low) / (high - low)
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1))


def _total(keys: list[str]) -> Column:
    return F.sum("n").over(Window.partitionBy(*keys))


def _targets(probabilities: list[float], total: Column) -> Column:
    """Wanted ranks (from 0) and what each counts for its quantile."""
    targets = []
    for p in probabilities:
        position = (total - 1) * F.lit(float(p))
        low = F.floor(position)
        share = position - low
        targets += [F.struct(F.lit(float(p)).alias("p"), (low + up).alias("rank"), weight.alias("weight"))
                    for up, weight in ((0, 1.0 - share), (1, share))]
    return F.filter(F.array(*targets), lambda t: t["weight"] > 0)


def _held(cells: DataFrame, keys: list[str], order: str, targets: Column) -> DataFrame:
    """Cells that hold wanted ranks, with the ranks counted from the cell's first row."""
    window = Window.partitionBy(*keys).orderBy(order)
    cells = cells.withColumn("targets", targets).withColumn("before", F.sum("n").over(window) - F.col("n"))
    if "high" in cells.columns:
        # Rounding never decreases along the values; should it ever, no answer is given.
        cells = cells.withColumn("before", F.when(
            F.lag("high").over(window) > F.col("low"),
            F.raise_error(F.lit("cells are not in the order of their values"))).otherwise(F.col("before")))
    inside = F.filter("targets", lambda t: (t["rank"] >= F.col("before"))
                      & (t["rank"] < F.col("before") + F.col("n")))
    return cells.withColumn("targets", F.transform(inside, lambda t: F.struct(
        t["p"].alias("p"), (t["rank"] - F.col("before")).alias("rank"), t["weight"].alias("weight")))).where(
        F.size("targets") > 0)


def value_ranks(df: DataFrame, value: str, extra: list[Column] | None = None) -> DataFrame:
    """One row per distinct value: (value, n, average_rank, total, extra...).

    Distinct values are written in range partitions (as many as their size asks for), numbered inside
    each and shifted by the totals of the partitions below; only those totals meet in one task.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("value")).agg(
        F.count("*").alias("n"), *(extra or []))
    placed = stored(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(F.sum("n").alias("part_n"))
    ordered = Window.orderBy("part")
    parts = parts.select(
        "part", (F.sum("part_n").over(ordered) - F.col("part_n")).alias("below"),
        F.sum("part_n").over(Window.partitionBy()).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    ranked = placed.join(settled(parts), "part").withColumn(
        "average_rank", F.col("below") + upto - F.col("n") + (F.col("n") + 1) / 2.0)
    return ranked.drop("part", "below")


def percent_rank_average(df: DataFrame, value: str, name: str) -> DataFrame:
    """Rank with ties averaged, divided by the number of values; null stays null."""
    ranks = value_ranks(df, value).select(
        F.col("value").alias("__value"),
        (F.col("average_rank") / F.col("total")).alias(name))
    return df.join(ranks, df[value].cast("double") == ranks["__value"], "left").drop("__value")


def roc_auc(df: DataFrame, label: str, score: str) -> Column:
    """Area under the ROC curve by the rank sum of the positives, as a scalar."""
    ranks = value_ranks(df, score, [F.sum(label).alias("positives")])
    sums = ranks.agg(
        F.sum(F.col("average_rank") * F.col("positives")).alias("rank_sum"),
        F.sum("positives").cast("double").alias("p"),
        F.sum(F.col("n") - F.col("positives")).cast("double").alias("q"),
    )
    area = (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return sums.select(area).scalar()


def decile_of(df: DataFrame, value: str, name: str = "decile", bins: int = 10) -> DataFrame:
    """Bin 1..bins by quantile edges; equal values share a bin, so no global sort is needed."""
    probabilities = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df, [value], probabilities).select(
        F.array(*[_name(p) for p in probabilities])).scalar()
    v = F.col(value).cast("double")
    binned = df.withColumn("__edges", edges)
    above = F.size(F.filter("__edges", lambda e: e < v))
    return binned.withColumn(name, F.when(v.isNotNull(), above + 1)).drop("__edges")
