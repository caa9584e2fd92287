"""Keys, lookups and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerfield import constants as K

UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def surrogate_key(*natural: Column) -> Column:
    """Repeatable UUID-shaped key of a natural key; null when any part is null.

    A lost task recomputes the same key, and facts can derive it without joining the dimension.
    """
    digest = F.sha2(F.concat(*_separated(natural)), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    parts = [F.substring(digest, start, length) for start, length in cuts]
    return F.concat(*[x for p in parts for x in (F.lit("-"), p)][1:])


def _separated(parts: tuple[Column, ...]) -> list[Column]:
    out = [parts[0].cast("string")]
    for part in parts[1:]:
        out += [F.lit("|"), part.cast("string")]
    return out


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID_PATTERN), F.lit(False))


def lookup(value: Column, table: dict, default) -> Column:
    """Value from a small constant table, else the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), value), F.lit(default))


def currency(region: Column) -> Column:
    return lookup(region, K.CURRENCY, "KES")


def risk_category(status: Column) -> Column:
    return lookup(status, K.RISK_CATEGORY, "Low Risk")


def lead_source_number(source: Column) -> Column:
    return lookup(source, K.LEAD_SOURCE_IDS, 0)


def country_number(region: Column) -> Column:
    return lookup(F.lower(region), K.COUNTRY_IDS, 0)


def title_case(text: Column) -> Column:
    """Capitals after everything but a letter, as in O'Neil or Guinea-Bissau; else lower case."""
    letters = F.split(text, "")
    return F.array_join(F.transform(letters, lambda c, i: F.when(
        (i > 0) & F.get(letters, i - 1).rlike(r"^\p{L}$"), F.lower(c)).otherwise(F.upper(c))), "")


def country_display_name(region: Column) -> Column:
    trimmed = F.lower(F.trim(region.cast("string")))
    known = F.create_map(*[F.lit(x) for pair in K.COUNTRY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, trimmed), title_case(trimmed), F.lit("Unknown"))


def product_tier(refurbished: Column) -> Column:
    """Tier of a yes/no flag; a missing flag means New."""
    return F.when(F.coalesce(refurbished.cast("boolean"), F.lit(False)), K.TIER_REFURBISHED) \
        .otherwise(K.TIER_NEW)


def product_tier_of_status(refurb_status: Column) -> Column:
    return F.when(refurb_status == K.TIER_REFURBISHED, K.TIER_REFURBISHED).otherwise(K.TIER_NEW)


def strip_prefix_number(value: Column, prefix: str) -> Column:
    """``LEAD-123`` -> 123; null when the rest is not a number."""
    return F.replace(value, F.lit(prefix), F.lit("")).try_cast("bigint")


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def without_sentinel(value: Column, sentinel) -> Column:
    return F.nullif(value, F.lit(sentinel))


def campaign_archetype(segment_name: Column) -> Column:
    """Which of the three campaigns a segment gets."""
    name = F.coalesce(segment_name, F.lit(""))
    return (
        F.when(name.contains("Stable Premium") | name.contains("Reliable"), "proven_grower")
        .when(name.contains("Early-Tenure"), "step_up")
        .otherwise("conservative")
    )


def contains_pattern(value: Column, pattern: str) -> Column:
    """Case-insensitive regular expression match; null does not match."""
    return F.coalesce(value.rlike("(?i)" + pattern), F.lit(False))
