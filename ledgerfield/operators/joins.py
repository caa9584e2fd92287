"""Equi-joins. Small sides are left to the optimizer, which broadcasts by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

def left_lookup(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]],
                spread_nulls_by: str | None = None) -> DataFrame:
    """Left join on pairs of (left name, right name); the right keys are dropped.

    Rows with a null key match nothing but would all hash to one task. ``spread_nulls_by`` names a
    left column with many values by which those rows are dealt over many tasks.
    """
    renamed = {r: f"__right_{r}" for _, r in keys}
    right = right.withColumnsRenamed(renamed)
    condition = None
    for l, r in keys:
        same = left[l] == right[renamed[r]]
        condition = same if condition is None else condition & same
    if spread_nulls_by is None:
        return left.join(right, condition, "left").drop(*renamed.values())
    if len(keys) == 1 and _text(left, keys[0][0]) and _text(right, renamed[keys[0][1]]):
        # One join key: a right side that lies by its key already is neither shuffled nor sorted again.
        l, r = left[keys[0][0]], right[renamed[keys[0][1]]]
        dealt = F.coalesce(l, F.concat(F.lit("\0"), left[spread_nulls_by].cast("string")))
        return left.join(right, (dealt == r) & l.isNotNull(), "left").drop(*renamed.values())
    missing = None
    for l, _ in keys:
        null = F.col(l).isNull()
        missing = null if missing is None else missing | null
    left = left.withColumn(
        "__spread",
        F.when(missing, F.xxhash64(spread_nulls_by))
        .otherwise(F.lit(0).cast("bigint")),
    )
    # Always 0, but not a constant: the optimizer would drop a constant from the join keys.
    nothing = F.pmod(F.xxhash64(*renamed.values()), F.lit(1))
    right = right.withColumn("__right_spread", nothing)
    condition = left["__spread"] == right["__right_spread"]
    for l, r in keys:
        condition = condition & (left[l] == right[renamed[r]])
    return left.join(right, condition, "left").drop("__spread", "__right_spread",
                                                    *renamed.values())


def _text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType == StringType()


def one_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by the order columns, then by the whole row.

    An aggregate, so copies of a hot key are reduced before the shuffle; a ranking window would
    sort them all in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordered = order + [c for c in rest if c not in order]
    first = F.min(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c)
                             for c in ordered])).alias("row")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*keys, *[F.col(f"row.{c}.v").alias(c) for c in rest])


def flag_members(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                 name: str) -> DataFrame:
    """1 when the left key occurs on the right, else 0."""
    members = right.select(F.col(right_key).alias("__member")).where("__member IS NOT NULL") \
        .distinct()
    joined = left.join(members, left[left_key] == members["__member"], "left")
    return joined.withColumn(name, F.col("__member").isNotNull().cast("int")).drop("__member")


def without_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose key does not occur on the right; a null key has no match."""
    others = right.select(F.col(right_key).alias("__other"))
    return left.join(others, left[left_key] == others["__other"], "left_anti")


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "full_outer")


def lookup_or_default(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]],
                      defaults: dict) -> DataFrame:
    """Left join where a missing match gives type defaults instead of null."""
    joined = left_lookup(left, right, keys)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def attach_group_values(df: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """Join an aggregate back to its rows, instead of a window that would hold a hot group in one
    task. The aggregate is combined before its shuffle; adaptive execution knows its size then,
    broadcasts a small one and splits the hot keys of a large join."""
    return left_lookup(df, grouped, [(key, key)])


def exclude_chosen(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return without_match(df, chosen, key, key)
