"""Balance and risk proxies of one account."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerfield import constants as K
from ledgerfield.functions.numbers import clip, clipped_ratio, round_even


def tier_ordinal(tier: Column) -> Column:
    return (
        F.when(tier == K.TIER_NEW, K.TIER_ORDINAL[K.TIER_NEW])
        .when(tier == K.TIER_REFURBISHED, K.TIER_ORDINAL[K.TIER_REFURBISHED])
        .otherwise(2)
    )


def is_payg(payment_type: Column) -> Column:
    return F.coalesce(payment_type == "PAYG", F.lit(False)).cast("int")


def financed_amount(tier_ord: Column, payment_type: Column) -> Column:
    return tier_ord * F.when(payment_type == "PAYG", K.FINANCED_PER_TIER_PAYG) \
        .otherwise(K.FINANCED_PER_TIER_CASH)


def outstanding_balance(financed: Column, healthy: Column, default: Column) -> Column:
    share = (
        F.when(healthy == 1, K.OUTSTANDING_SHARE_HEALTHY)
        .when(default == 1, K.OUTSTANDING_SHARE_DEFAULT)
        .otherwise(K.OUTSTANDING_SHARE_OTHER)
    )
    return financed * share


def arrears_balance(outstanding: Column, in_arrears: Column) -> Column:
    return F.when(in_arrears == 1, outstanding * K.ARREARS_SHARE).otherwise(0.0)


def days_past_due(age_days: Column, in_arrears: Column, default: Column) -> Column:
    aged = clip(age_days * 0.15, 7.0, 90.0).cast("int")
    return F.when(in_arrears == 1, aged).when(default == 1, 90).otherwise(0)


def repayment_progress(outstanding: Column, financed: Column) -> Column:
    paid = 1.0 - F.try_divide(outstanding.cast("double"), financed.cast("double"))
    return F.coalesce(clip(paid, 0.0, 1.0), F.lit(0.5))


def outstanding_to_financed(outstanding: Column, financed: Column) -> Column:
    return clipped_ratio(outstanding, financed, 0.0, 2.0)


def arrears_rate(arrears: Column, outstanding: Column) -> Column:
    return clipped_ratio(arrears, outstanding, 0.0, 1.0)


def risk_stress_score(in_arrears: Column, default: Column, days_past_due_cap: Column) -> Column:
    return 0.4 * in_arrears + 0.4 * default + 0.2 * (days_past_due_cap / 90.0)


def debt_to_income(debt: Column, income: Column) -> Column:
    return debt / F.when(income == 0, 1).otherwise(income)


def lead_quality(account: Column, sale: Column, installation: Column) -> Column:
    to_account, to_sale, to_installation = K.LEAD_QUALITY_WEIGHTS
    score = account * to_account + sale * to_sale + installation * to_installation
    return score.cast("float")


def lead_quality_with_speed(account: Column, sale: Column, installation: Column,
                            days_to_account: Column) -> Column:
    to_account, to_sale, to_installation = K.LEAD_QUALITY_WEIGHTS_WITH_SPEED
    bonus = K.LEAD_SPEED_WEIGHT * F.greatest(
        F.lit(0.0), 1.0 - days_to_account / K.LEAD_SPEED_DECAY_DAYS
    )
    score = account * to_account + sale * to_sale + installation * to_installation
    score = score + F.when(days_to_account.isNotNull(), bonus).otherwise(0.0)
    return round_even(F.least(score, F.lit(1.0)), 6).cast("float")


def segment_name(default_rate: Column, arrears: Column, progress: Column, financed: Column,
                 financed_median: Column) -> Column:
    return (
        F.when(default_rate > 0.35, "Distressed Defaulters")
        .when(arrears > 0.4, "Arrears-Stressed PAYG")
        .when((progress > 0.65) & (financed >= financed_median), "Stable Premium Growers")
        .when(progress > 0.55, "Reliable Mid-Tier")
        .otherwise("Early-Tenure Builders")
    )
