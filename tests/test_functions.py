"""Edges of the column helpers."""

from pyspark.sql import functions as F

from ledgerfield.functions import buckets, dates, keys, money, numbers


def values(df, *columns):
    return [r[0] for r in df.select(*columns).collect()]


def test_lenient_parse(rows):
    df = rows([("2024-02-29",), ("2024-02-30",), ("",), (None,), ("soon",),
               ("2024-01-01 10:20:30",), ("03/04/2024",)], "t string")
    plain = values(df, dates.parse_timestamp(F.col("t")).cast("string"))
    assert plain == ["2024-02-29 00:00:00", None, None, None, None, "2024-01-01 10:20:30", None]
    more = values(df, dates.parse_date(F.col("t"), ["dd/MM/yyyy"]).cast("string"))
    assert more[-1] == "2024-04-03"


def test_elapsed_days_round_down_in_both_directions(rows):
    df = rows([("2024-01-02 00:00:00", "2024-01-01 12:00:00"),
               ("2024-01-01 12:00:00", "2024-01-02 00:00:00"),
               ("2024-01-01 00:00:00", "2024-01-01 00:00:00"),
               ("2024-01-03 00:00:00", "2024-01-01 00:00:00"),
               (None, "2024-01-01 00:00:00")], "a string, b string")
    a, b = dates.parse_timestamp(F.col("a")), dates.parse_timestamp(F.col("b"))
    assert values(df, dates.elapsed_days(a, b)) == [0, -1, 0, 2, None]
    assert values(df, dates.elapsed_days(a, b, "clamp")) == [0, 0, 0, 2, None]
    assert values(df, dates.elapsed_days(a, b, "null_negative")) == [0, None, 0, 2, None]
    assert values(df, dates.calendar_days(a, b)) == [1, -1, 0, 2, None]


def test_elapsed_days_ignore_the_session_zone(spark, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = rows([("2024-03-31 12:00:00", "2024-03-30 12:00:00")], "a string, b string")
    days = dates.elapsed_days(dates.parse_timestamp(F.col("a")), dates.parse_timestamp(F.col("b")))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert values(df, days) == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bucket_edges(rows):
    ages = [0, 18, 19, 25, 26, 35, 36, 40, 50, 51, 60, 100, 101, None]
    df = rows([(a,) for a in ages], "a int")
    assert values(df, buckets.age_bucket_adult(F.col("a"))) == [
        None, "0-18", "19-35", "19-35", "19-35", "19-35", "36-50", "36-50", "36-50", "51+", "51+",
        "51+", None, None]
    assert values(df, buckets.age_group(F.col("a"))) == [
        "<25", "<25", "<25", "<25", "25-40", "25-40", "25-40", "25-40", "40-60", "40-60", "40-60",
        "60+", None, None]
    assert values(df, buckets.age_bucket_customer(F.col("a"))) == [
        "<25", "<25", "<25", "25-34", "25-34", "35-49", "35-49", "35-49", "50+", "50+", "50+",
        "50+", "50+", "Unknown"]
    days = rows([(d,) for d in (-1, 0, 180, 181, 365, 366, 730, 731, 10000, 10001)], "d int")
    assert values(days, buckets.tenure_bucket(F.col("d"))) == [
        None, "<6m", "<6m", "6-12m", "6-12m", "1-2y", "1-2y", "2y+", "2y+", None]


def test_ages(rows):
    df = rows([("2000-01-01",), ("1900-01-01",), ("2020-01-01",), (None,)], "b string")
    birth, at = dates.parse_date(F.col("b")), F.lit("2025-01-01").cast("date")
    assert values(df, buckets.age_by_calendar_year(birth, at)) == [25, 125, 5, 0]
    assert values(df, buckets.age_by_days(birth, at)) == [25, 90, 18, None]


def test_keys(rows):
    df = rows([("a", "b"), ("a", None), ("ab", ""), ("a", "b")], "x string, y string")
    made = values(df, keys.surrogate_key(F.col("x"), F.col("y")))
    assert made[0] == made[3] and made[1] is None and len(set(made)) == 3
    assert values(df, keys.is_uuid(keys.surrogate_key(F.col("x")))) == [True] * 4
    assert values(df, keys.is_uuid(F.col("y"))) == [False] * 4
    ids = rows([("LEAD-12",), ("LEAD-x",), (None,)], "i string")
    assert values(ids, keys.strip_prefix_number(F.col("i"), "LEAD-")) == [12, None, None]


def test_lookups(rows):
    df = rows([(" KENYA ",), ("civ",), ("south sudan",), (None,)], "r string")
    assert values(df, keys.country_display_name(F.col("r"))) == [
        "Kenya", "Côte d'Ivoire", "South Sudan", "Unknown"]
    assert values(df, keys.currency(F.col("r"))) == ["KES", "CFA Franc", "KES", "KES"]
    flags = rows([(True,), (False,), (None,)], "f boolean")
    assert values(flags, keys.product_tier(F.col("f"))) == ["Refurbished", "New", "New"]
    names = rows([("Stable Premium Growers",), ("Early-Tenure Builders",), (None,)], "s string")
    assert values(names, keys.campaign_archetype(F.col("s"))) == [
        "proven_grower", "step_up", "conservative"]
    assert values(names, keys.contains_pattern(F.col("s"), "PREMIUM|tenure")) == [
        True, True, False]


def test_money(rows):
    df = rows([(1000, 1, 0), (10, 1, 0), (100, 1, 1), (100, 0, 1), (100, 0, 0)],
              "age int, arrears int, failed int")
    assert values(df, money.days_past_due(F.col("age"), F.col("arrears"), F.col("failed"))) == [
        90, 7, 15, 90, 0]
    ratio = rows([(50.0, 100.0), (300.0, 100.0), (1.0, 0.0), (None, 5.0)], "o double, f double")
    assert values(ratio, money.outstanding_to_financed(F.col("o"), F.col("f"))) == [0.5, 2, 0, 0]
    assert values(ratio, money.repayment_progress(F.col("o"), F.col("f"))) == [0.5, 0, 0.5, 0.5]
    lead = rows([(1, 1, 1, 0), (1, 0, 0, 45), (1, 1, 1, None), (0, 0, 0, 500)],
                "a int, s int, i int, d int")
    score = money.lead_quality_with_speed(*[F.col(c) for c in "asid"])
    assert [round(v, 4) for v in values(lead, score)] == [1.0, 0.45, 0.9, 0.0]


def test_numbers(rows):
    df = rows([(1.0, 0.0), (None, 2.0), (6.0, 3.0)], "a double, b double")
    assert values(df, numbers.safe_divide(F.col("a"), F.col("b"), -1.0)) == [-1, -1, 2]
    assert values(df, numbers.clip(F.col("a"), 2.0, 5.0)) == [2, None, 5]
    half = rows([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert values(half, numbers.round_even(F.col("x"))) == [0, 2, 2, 0]


def test_segment_names_are_tested_in_order(rows):
    df = rows([(0.4, 0.9, 0.9, 10.0), (0.3, 0.5, 0.9, 10.0), (0.0, 0.0, 0.7, 10.0),
               (0.0, 0.0, 0.7, 1.0), (0.0, 0.0, 0.5, 10.0)],
              "d double, a double, p double, f double")
    name = money.segment_name(*[F.col(c) for c in "dapf"], F.lit(5.0))
    assert values(df, name) == [
        "Distressed Defaulters", "Arrears-Stressed PAYG", "Stable Premium Growers",
        "Reliable Mid-Tier", "Early-Tenure Builders"]
