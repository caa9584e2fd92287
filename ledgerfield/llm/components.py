"""Connected components of links, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfield.llm.tables import written


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); the root is the smallest node linked to.

    Alternating star contraction: each node's larger neighbours are tied to its smallest neighbour,
    then each node and its smaller neighbours are. Every round is written, so that no lineage
    grows; the number of rounds grows with the logarithm of the nodes. Only rows are joined to the
    minimum of their node, so a node with many links is split like any skewed join.
    """
    edges = written(spark, links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low"))
        large = large.where("u <> low").select("u", F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(
            F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(spark, small.unionByName(
            low.select("u", F.col("low").alias("v"))).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
