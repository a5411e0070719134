"""What a row shows: percentage, label, summary, class and locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.policy import choose
from tidemark.functions.text import any_term, trim_all


def present(level: Column, status: Column, locale: str, rate: Column, summary: Column) -> dict[str, Column]:
    pending = status == "INSUFFICIENT_SIGNAL"
    percentage = F.when(~pending, choose(level, rules.BAND_PERCENTAGE, None))
    own_label = F.when(pending, rules.PENDING_LABEL[locale]).otherwise(
        F.concat(percentage.cast("string"), F.lit("%"))
    )
    own_summary = F.when(pending, rules.PENDING_SUMMARY[locale]).otherwise(
        choose(level, rules.BAND_SUMMARY[locale], None)
    )
    stored = (status == "RATED") & rate.isNotNull()
    return {
        "percentage": percentage,
        "label": F.when(stored, F.concat(rate.cast("string"), F.lit("%"))).otherwise(own_label),
        "summary": F.coalesce(summary, own_summary),
        "class_name": F.when(pending, "risk-insufficient").otherwise(F.concat(F.lit("risk-"), F.lower(level))),
    }


def is_placeholder(summary: Column) -> Column:
    return F.coalesce(any_term(summary, rules.PLACEHOLDER_SUMMARIES), F.lit(False))


def timeline_summary(count: Column, locale: str) -> Column:
    texts = rules.TIMELINE_SUMMARY[locale]
    n = count.cast("string")
    if locale == "zh":
        return F.concat(F.lit(texts[0]), n, F.lit(texts[1]))
    plural = F.when(count == 1, "").otherwise("s")
    return F.concat(F.lit(texts[0]), n, F.lit(texts[1]), plural, F.lit(texts[2]))


def resolved_summary(summary: Column, count: Column, locale: str) -> Column:
    """A known placeholder gives way to a counted text once the timeline has rows."""
    return F.when((count > 0) & is_placeholder(summary), timeline_summary(count, locale)).otherwise(summary)


def has_chinese_name(name_en: Column, name_zh: Column) -> Column:
    return (F.length(trim_all(name_zh)) > 0) & (name_zh != name_en)


def local_name(name_en: Column, name_zh: Column, locale: str) -> Column:
    return name_zh if locale == "zh" else name_en
