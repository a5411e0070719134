"""Enum mappings, item strategy, signal policy and evidence weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.rates import round_cents
from tidemark.functions.text import trim_all


def choose(c: Column, table: Mapping[str, object], default: object) -> Column:
    chain = None
    for key, value in table.items():
        chain = F.when(c == key, F.lit(value)) if chain is None else chain.when(c == key, F.lit(value))
    return chain.otherwise(F.lit(default))


# ---- enum mappings ---------------------------------------------------------------------------
def source_kind(source_type: Column) -> Column:
    return choose(
        source_type, {"COMPANY_UPDATE": "official", "BLOG": "official", "JOB_POSTING": "jobs"}, "media"
    )


def decision_status(status: Column) -> Column:
    return choose(status, {"accepted": "ACCEPTED", "ambiguous": "AMBIGUOUS"}, "UNMATCHED")


def confidence(value: Column) -> Column:
    return F.when(F.length(value) > 0, F.upper(value))


def impact_direction(value: Column) -> Column:
    return F.when(value == "neutral", "MAINTAIN").otherwise(F.upper(value))


def stored_relevance(value: Column) -> Column:
    return F.when(value == "none", "LOW").otherwise(F.upper(value))


def mapping_mode(value: Column) -> Column:
    return F.when(value == "observe_only", "OBSERVE_ONLY").otherwise("DIRECT_MAPPED")


def confidence_of_relevance(relevance: Column) -> Column:
    return F.when(relevance.isin("high", "medium"), relevance).when(relevance == "none", None).otherwise("low")


def _policy_type(value: Column) -> Column:
    v = F.upper(trim_all(value))
    return (
        F.when(v.isin("ADOPTION", "ADOPTION_CASE", "CAPABILITY_UPDATE", "WORKFLOW_RESTRUCTURE"), "ADOPTION")
        .when(v == "HIRING_SHIFT", "HIRING_SHIFT")
        .when(v.isin("TOOLING", "ECOSYSTEM_CONTEXT"), "TOOLING")
    )


RAW_TYPE_KEYS = ("signalType", "sourceValue", "value", "policySignalType")
RAW_VETO_KEY = "strategyCanAffectReplacementRate"


def with_raw_fields(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Adds the policy fields of a JSON column: ``raw_type_1..4`` and ``raw_veto``.

    The text is parsed once per row: a generator's output is never inlined into later filters.
    """
    schema = ", ".join(f"{k} string" for k in RAW_TYPE_KEYS) + f", {RAW_VETO_KEY} boolean"
    names = [f"raw_type_{i}" for i in range(1, 5)] + ["raw_veto"]
    return df.select("*", F.inline(F.array(F.from_json(raw, schema))).alias(*names))


def policy_signal_type(source_type: Column) -> Column:
    """First usable type among the four raw fields, else the one implied by the source type."""
    stated = [_policy_type(F.col(f"raw_type_{i}")) for i in range(1, 5)]
    implied = choose(source_type, {"JOB_POSTING": "HIRING_SHIFT", "COMPANY_UPDATE": "ADOPTION"}, "TOOLING")
    return F.coalesce(*stated, implied)


# ---- item strategy and signal policy ---------------------------------------------------------
def item_strategy(source_class: Column, source_type: Column, kind: Column, signal: Column) -> Column:
    """Four strategies of four fields; ``kind`` and ``signal`` are NULL without a classification."""

    def strategy(name: str, default: str, affects: bool, bias: str) -> Column:
        return F.struct(
            F.lit(name).alias("strategy_id"),
            F.lit(default).alias("default_signal_type"),
            F.lit(affects).alias("can_affect_rate"),
            F.lit(bias).alias("attribution_bias"),
        )

    broad = strategy("broad_ecosystem_context", "ecosystem_context", False, "conservative")
    return (
        F.when((kind == "other") | (signal == "ecosystem_context"), broad)
        .when((source_type == "JOB_POSTING") | (source_class == "jobs"),
              strategy("jobs_hiring_shift", "hiring_shift", True, "balanced"))
        .when(source_class == "official",
              strategy("official_capability_update", "capability_update", True, "balanced"))
        .when(source_class == "media",
              strategy("media_adoption_case", "adoption_case", True, "conservative"))
        .otherwise(broad)
    )


def signal_strength(weight: Column) -> Column:
    return F.when(weight >= 0.85, "HIGH").when(weight >= 0.5, "MEDIUM").otherwise("LOW")


def is_discovery(catalog_id: Column) -> Column:
    return F.coalesce(F.startswith(catalog_id, F.lit(rules.DISCOVERY_PREFIX)), F.lit(False))


def signal_policy(
    source_class: Column,
    catalog_id: Column,
    assigned_slug: Column,
    default_signal_type: Column,
    can_affect_rate: Column,
    relevance: Column,
    weight_label: Column,
    kind: Column,
    signal: Column,
) -> Column:
    """Type, strength, weight and whether to keep the signal.

    ``kind`` is NULL without a classification. Keeping is decided on the weight before the
    discovery discount.
    """
    of_signal = {
        "capability_update": "ADOPTION", "adoption_case": "ADOPTION",
        "workflow_restructure": "ADOPTION", "hiring_shift": "HIRING_SHIFT",
        "ecosystem_context": "TOOLING",
    }
    of_default = {"hiring_shift": "HIRING_SHIFT", "ecosystem_context": "TOOLING"}
    signal_type = F.coalesce(
        choose(signal, of_signal, None), choose(default_signal_type, of_default, "ADOPTION")
    )
    # factors lie within 0..1, so rounding is all the clamp has to do
    base = round_cents(
        choose(source_class, rules.CLASS_FACTOR, 0.0)
        * choose(F.coalesce(weight_label, F.lit("supporting")), rules.LABEL_FACTOR, 0.0)
        * choose(F.coalesce(relevance, F.lit("none")), rules.RELEVANCE_FACTOR, 0.0)
    )
    weight = round_cents(
        base * F.when(is_discovery(catalog_id), F.lit(rules.INGEST_DISCOVERY_FACTOR)).otherwise(F.lit(1.0))
    )
    eligible = (
        F.coalesce(F.length(assigned_slug) > 0, F.lit(False))
        & kind.isNotNull()
        & (kind != "other")
        & (relevance != "none")
        & (signal != "ecosystem_context")
        & can_affect_rate
        & F.when(source_class == "jobs", signal == "hiring_shift")
        .when(source_class == "official", (relevance != "low") & (base >= 0.5))
        .when(source_class == "media", (relevance == "high") & (base >= 0.5))
    )
    return F.struct(
        signal_type.alias("signal_type"),
        signal_strength(weight).alias("signal_strength"),
        weight.alias("signal_weight"),
        F.coalesce(eligible, F.lit(False)).alias("keep_signal"),
    )


def legacy_strength(source_type: Column, signal_type: Column) -> Column:
    """Strength of an item without a classification."""
    return (
        F.when((source_type == "COMPANY_UPDATE") & (signal_type == "ADOPTION"), "HIGH")
        .when(source_type == "JOB_POSTING", "MEDIUM")
        .otherwise("LOW")
    )


# ---- evidence weights ------------------------------------------------------------------------
def evidence_weight(
    weight: Column, catalog_id: Column, kind: Column, signal_type: Column, relevance: Column, impact: Column
) -> Column:
    """Product of six factors from left to right, two decimals."""
    return round_cents(
        weight.cast("double")
        * F.when(is_discovery(catalog_id), F.lit(rules.SCORING_DISCOVERY_FACTOR)).otherwise(F.lit(1.0))
        * choose(kind, rules.SCORING_SOURCE_FACTOR, None)
        * choose(signal_type, rules.SCORING_TYPE_FACTOR, None)
        * choose(relevance, rules.SCORING_RELEVANCE_FACTOR, rules.SCORING_RELEVANCE_FACTOR["LOW"])
        * choose(impact, rules.SCORING_IMPACT_FACTOR, rules.SCORING_IMPACT_FACTOR["MAINTAIN"])
    )


def minimum_weight(kind: Column, catalog_id: Column, relevance: Column) -> Column:
    return (
        F.when((kind == "media") & is_discovery(catalog_id), F.lit(0.2))
        .when(kind == "official", F.lit(0.25))
        .when(kind == "jobs", F.lit(0.28))
        .when(relevance == "MEDIUM", F.lit(0.3))
        .otherwise(F.lit(0.4))
    )


def is_excluded(
    kind: Column, signal_type: Column, relevance: Column, impact: Column, weight: Column, veto: Column
) -> Column:
    """The seven reasons to leave an item out of the score."""
    return (
        F.coalesce(~veto, F.lit(False))
        | ((kind == "media") & (signal_type == "TOOLING"))
        | ((kind == "jobs") & (signal_type != "HIRING_SHIFT"))
        | ((kind == "jobs") & (signal_type == "HIRING_SHIFT") & (weight < 0.3))
        | ((kind == "media") & (relevance == "MEDIUM") & (weight < 0.6))
        | ((relevance == "LOW") & (kind != "official"))
        | ((impact == "MAINTAIN") & (signal_type == "TOOLING"))
    )


# ---- discovery evidence ----------------------------------------------------------------------
def hit_relevance(attribution: Column, score: Column) -> Column:
    conf = F.coalesce(attribution, F.lit(0.0))
    return (
        F.when((conf >= 0.8) | (score >= 8), "high")
        .when((conf >= 0.55) | (score >= 5), "medium")
        .otherwise("low")
    )


def hit_weight(attribution: Column, score: Column) -> Column:
    boost = F.when(
        F.coalesce(attribution, F.lit(0.0)) != 0.0, F.least(F.lit(0.18), attribution * F.lit(0.2))
    ).otherwise(F.lit(0.0))
    by_score = F.least(
        F.lit(0.16), F.greatest(F.lit(0.0), score.cast("double") - F.lit(4.0)) * F.lit(0.03)
    )
    return F.least(F.lit(0.88), F.lit(0.42) + boost + by_score)
