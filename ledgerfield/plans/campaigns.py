"""Which segments suit a premium loan campaign, and how segments look."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerfield import constants as K
from ledgerfield.functions.keys import campaign_archetype
from ledgerfield.functions.numbers import clip
from ledgerfield.operators.aggregates import share_of
from ledgerfield.operators.joins import exclude_chosen
from ledgerfield.operators.ordering import top_per_group, top_two_with_filler


def _in_country(customers: DataFrame, country: str) -> DataFrame:
    """Customers of a country, or all when it has none. The test is part of the same query."""
    here = F.coalesce(F.lower("country_name") == country.lower(), F.lit(False))
    any_here = customers.select(F.coalesce(F.max(here), F.lit(False))).scalar()
    return customers.where(here | ~any_here)


def campaign_scores(customers: DataFrame, country: str = "Kenya") -> DataFrame:
    """Score per segment of the country. The window spans the segments, not the customers."""
    rows = _in_country(customers, country).na.drop(subset=["segment_id", "segment_name"])
    segments = rows.groupBy("segment_id", "segment_name").agg(
        F.count("customer_id").alias("customers"),
        F.avg("repayment_progress").alias("stability"),
        F.avg("financed_amount").alias("affluence"),
        F.avg("account_age_days").alias("growth"),
        F.avg("is_default").alias("default_rate"),
        F.avg("is_in_arrears").alias("arrears_rate"),
        share_of("payment_type", "PAYG").alias("payg_share"))
    every = Window.partitionBy()
    part = lambda c: F.try_divide(F.col(c).cast("double"), F.max(c).over(every).cast("double"))
    scored = segments.withColumns({
        "size_score": part("customers"),
        "stability_score": F.col("stability"),
        "affluence_score": part("affluence"),
        "growth_score": 1.0 - clip(part("growth"), 0.0, 1.0),
        "low_default_score": 1.0 - F.col("default_rate"),
    })
    total = sum((F.col(f"{name}_score") * w for name, w in K.CAMPAIGN_WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn(
        "campaign_score",
        total - K.CAMPAIGN_ARREARS_PENALTY * F.col("arrears_rate")
        - K.CAMPAIGN_DEFAULT_PENALTY * F.col("default_rate"))


def is_eligible():
    return (
        (F.col("arrears_rate") <= K.ELIGIBLE_MAX_ARREARS)
        & (F.col("default_rate") <= K.ELIGIBLE_MAX_DEFAULT)
        & (F.col("stability") >= K.ELIGIBLE_MIN_STABILITY)
    )


def top_two_segments(scores: DataFrame) -> DataFrame:
    """The two best eligible segments, filled up with the best of the rest."""
    return top_two_with_filler(scores, is_eligible(), "campaign_score", "segment_id")


def with_archetype(segments: DataFrame) -> DataFrame:
    return segments.withColumn("archetype", campaign_archetype(F.col("segment_name")))


def rejected_segments(customers: DataFrame, country: str = "Kenya") -> DataFrame:
    """Segments of the country outside the top two."""
    here = customers.where(F.lower("country_name") == country.lower()) \
        .na.drop(subset=["segment_id", "segment_name"])
    rates = here.groupBy("segment_id", "segment_name").agg(
        F.avg("is_in_arrears").alias("arrears"), F.avg("is_default").alias("default"))
    chosen = top_two_segments(campaign_scores(customers, country)).select("segment_id")
    return exclude_chosen(rates, chosen, "segment_id")


def segment_cards(customers: DataFrame) -> DataFrame:
    """Size and mean figures per segment."""
    total = customers.select(F.count("*")).scalar()
    cards = customers.na.drop(subset=["segment_id"]).groupBy("segment_id", "segment_name").agg(
        F.count("*").alias("customers"),
        F.avg("repayment_progress").alias("avg_repayment"),
        (F.avg("is_in_arrears") * 100).alias("arrears_pct"),
        (F.avg("is_default") * 100).alias("default_pct"),
        F.avg("financed_amount").alias("avg_financed"),
        F.avg("account_age_days").alias("avg_account_age"))
    return cards.withColumn("pct_of_portfolio", F.col("customers") * 100.0 / total)


def segment_value_counts(customers: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values per segment by frequency; ``top`` keeps the most frequent ones of each segment."""
    counts = customers.na.drop(subset=["segment_id", column]) \
        .groupBy("segment_id", F.col(column).alias("value")).agg(F.count("*").alias("customers"))
    if top is None:
        return counts
    return top_per_group(counts, ["segment_id"], [F.col("customers").desc(), F.col("value")], top)
