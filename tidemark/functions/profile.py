"""Score profile of a role from its dictionary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.rates import band
from tidemark.functions.text import any_term


def profile_text(slug: Column, name_en: Column, keywords: Column) -> Column:
    """The text the term groups are looked up in; ``keywords`` is an array."""
    return F.lower(F.array_join(F.concat(F.array(slug, name_en), keywords), " "))


def profile_columns(text: Column, source_count: Column) -> dict[str, Column]:
    """Rate, level and seven scores, by name."""
    repeated = any_term(text, rules.REPEATED_TEXT_TERMS)
    software = any_term(text, rules.SOFTWARE_TERMS)
    physical = any_term(text, rules.PHYSICAL_TERMS)
    judgment = any_term(text, rules.JUDGMENT_TERMS)

    def points(flag: Column, n: int) -> Column:
        return F.when(flag, n).otherwise(0)

    raw = (
        F.lit(rules.PROFILE_BASE)
        + points(repeated, 18)
        + points(software, 22)
        - points(physical, 16)
        - points(judgment, 8)
        + F.when(source_count > 0, F.least(F.lit(10), source_count * 2)).otherwise(0)
    )
    rate = F.greatest(F.lit(rules.PROFILE_MIN), F.least(F.lit(rules.PROFILE_MAX), raw)).cast("int")

    def score(flag: Column, yes: int, no: int) -> Column:
        return F.when(flag, yes).otherwise(no)

    return {
        "replacement_rate": rate,
        "risk_level": band(rate),
        "rating_status": F.lit("RATED"),
        "repetition_score": score(repeated, 4, 2),
        "rule_clarity_score": score(repeated, 4, 2),
        "transformation_score": score(software, 5, 3),
        "workflow_automation_score": score(software | repeated, 4, 2),
        "interpersonal_score": score(judgment, 4, 2),
        "physicality_score": score(physical, 5, 1),
        "ambiguity_score": score(judgment, 4, 2),
    }


def profile_summary(source_count: Column, locale: str) -> Column:
    texts = rules.PROFILE_SUMMARY
    if locale == "en":
        head, unit, tail = texts["tracked_en"]
        tracked = F.concat(
            F.lit(head), source_count.cast("string"), F.lit(unit),
            F.when(source_count == 1, "").otherwise("s"), F.lit(tail),
        )
    else:
        head, tail = texts["tracked_zh"]
        tracked = F.concat(F.lit(head), source_count.cast("string"), F.lit(tail))
    return F.when(source_count > 0, tracked).otherwise(F.lit(texts[f"none_{locale}"]))


def profile_reasons(text: Column, source_count: Column) -> Column:
    software = any_term(text, rules.SOFTWARE_TERMS)
    repeated = any_term(text, rules.REPEATED_TEXT_TERMS)
    physical = any_term(text, rules.PHYSICAL_TERMS)
    judgment = any_term(text, rules.JUDGMENT_TERMS)

    def detail(side: int, first: Column, a: str, second: Column, b: str, c: str) -> Column:
        d = rules.REASON_DETAILS
        return F.when(first, d[a][side]).when(second, d[b][side]).otherwise(d[c][side])

    def reason(kind: str, title: str, en: Column, zh: Column) -> Column:
        title_en, title_zh = rules.REASON_TITLES[title]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(title_en).alias("title_en"),
            F.lit(title_zh).alias("title_zh"),
            en.alias("detail_en"),
            zh.alias("detail_zh"),
        )

    always = F.array(
        reason("structure", "profile",
               detail(0, software, "software", repeated, "repeated", "neither"),
               detail(1, software, "software", repeated, "repeated", "neither")),
        reason("structure", "constraints",
               detail(0, physical, "physical", judgment, "judgment", "exposed"),
               detail(1, physical, "physical", judgment, "judgment", "exposed")),
    )
    no_source = reason("media", "no_source",
                       F.lit(rules.REASON_DETAILS["no_source"][0]),
                       F.lit(rules.REASON_DETAILS["no_source"][1]))
    return F.when(source_count > 0, always).otherwise(F.concat(always, F.array(no_source)))


def structural_result(base: Column, boost: Column, signals: Column) -> dict[str, Column]:
    """Status, level and trend from the structural sum and the boost of a role's signals."""
    total = base + boost
    thin = (total < 2) & (signals == 0)
    rising = F.when(boost > 0, "RISING").otherwise("STABLE")
    return {
        "status": F.when(thin, "INSUFFICIENT_SIGNAL").otherwise("RATED"),
        "level": F.when(thin, "LOW").when(total >= 14, "SEVERE").when(total >= 7, "HIGH")
        .when(total >= 4, "MEDIUM").otherwise("LOW"),
        "trend": F.when(thin, "STABLE").when(total >= 14, "RISING").when(total >= 4, rising)
        .otherwise("STABLE"),
    }
