"""Rates and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules


def round_half_up(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c.cast("double") + F.lit(0.5))


def round_cents(c: Column) -> Column:
    return F.floor(c.cast("double") * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def clamp_rate(c: Column, low: int = rules.MIN_RATE, high: int = rules.MAX_RATE) -> Column:
    rounded = round_half_up(c)
    return F.when(
        rounded.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), rounded)).cast("int")
    )


def band(rate: Column) -> Column:
    chain = F.when(rate >= rules.BANDS[0][0], rules.BANDS[0][1])
    for floor, name in rules.BANDS[1:]:
        chain = chain.when(rate >= floor, name)
    return F.when(rate.isNotNull(), chain.otherwise(rules.LOWEST_BAND))


def severity_rank(level: Column) -> Column:
    chain = F.when(level == rules.SEVERITY_ORDER[0], 0)
    for i, name in enumerate(rules.SEVERITY_ORDER[1:], start=1):
        chain = chain.when(level == name, i)
    return chain


def clamp_weight(c: Column) -> Column:
    """Two decimals within 0..1; what is not finite counts as nothing."""
    x = c.cast("double")
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), round_cents(x)))
    return F.when(F.abs(x) < F.lit(float("inf")), bounded).otherwise(F.lit(0.0))


def delta(previous: Column, current: Column) -> Column:
    return current - previous


def direction(previous: Column, current: Column) -> Column:
    d = delta(previous, current)
    return F.when(d > 0, "up").when(d < 0, "down").when(d == 0, "flat")


def bar_share(rate: Column, largest: Column) -> Column:
    """Width of a bar in percent of the longest one, at least 8."""
    return F.greatest(
        F.lit(8.0), rate.cast("double") / F.greatest(largest.cast("double"), F.lit(1.0)) * F.lit(100.0)
    )


def normalised_reasons(reasons: Column) -> Column:
    """Chinese texts fall back to the English ones."""
    return F.transform(
        reasons,
        lambda r: F.struct(
            r["kind"].alias("kind"),
            r["title_en"].alias("title_en"),
            F.coalesce(r["title_zh"], r["title_en"]).alias("title_zh"),
            r["detail_en"].alias("detail_en"),
            F.coalesce(r["detail_zh"], r["detail_en"]).alias("detail_zh"),
        ),
    )
