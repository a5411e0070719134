"""Evidence per role: the pool, the weighted and filtered top rows, coverage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import policy
from tidemark.functions.bind import bind
from tidemark.functions.text import by_name
from tidemark.functions.urls import is_public
from tidemark.operators.ranking import top_k


def evidence_pool(
    evidence: DataFrame,
    recent: int = rules.EVIDENCE_RECENT_WINDOW,
    backstop: int = rules.EVIDENCE_BACKSTOP_WINDOW,
) -> DataFrame:
    """Per role the newest ``recent`` rows and the newest ``backstop`` rows outside discovery.

    Each lane is ranked on its own first, which keeps the group limit below its shuffle: of discovery rows only the newest
    ``recent`` can count. Both lanes are dealt by role, so the ranking over what they leave needs no second shuffle.
    """
    newest = [F.col("published_at").desc(), F.col("item_id").asc()]
    found = policy.is_discovery(F.col("source_catalog_id"))
    own = top_k(evidence.filter(~found), ["role_slug"], newest, max(recent, backstop), rank="_in_lane")
    other = top_k(evidence.filter(found), ["role_slug"], newest, recent, rank="_in_lane").withColumn(
        "_in_lane", F.lit(None).cast("int"))
    by_role = Window.partitionBy("role_slug").orderBy(*newest)
    return (
        own.unionByName(other).withColumn("_in_role", F.row_number().over(by_role))
        .filter((F.col("_in_role") <= recent) | (F.col("_in_lane") <= backstop))
        .drop("_in_lane", "_in_role")
    )


def judged_evidence(evidence: DataFrame) -> DataFrame:
    """Adds source kind, policy signal type, adjusted weight and ``counts``, whether a row counts for the score."""
    weight = F.col("signal_weight")
    kind = F.col("source_kind")
    signal = F.col("policy_signal_type")
    relevance = F.col("relevance")
    impact = F.col("impact")
    catalog = F.col("source_catalog_id")
    own_kind = policy.source_kind(F.col("source_type"))
    # needs no JSON, so it spares the parse
    relevant = F.coalesce((relevance != "LOW") | (own_kind == "official"), F.lit(False))
    typed = bind(
        policy.with_raw_fields(evidence.withColumn("_raw", F.when(relevant, F.col("raw_json"))), "_raw"),
        source_kind=own_kind,
        policy_signal_type=policy.policy_signal_type(F.col("source_type")),
    )
    weighed = bind(typed, adjusted_weight=policy.evidence_weight(weight, catalog, kind, signal, relevance, impact))
    counts = (
        relevant & ~policy.is_excluded(kind, signal, relevance, impact, weight, F.col("raw_veto"))
        & (F.col("adjusted_weight") >= policy.minimum_weight(kind, catalog, relevance))
    )
    return weighed.withColumn("counts", F.coalesce(counts, F.lit(False))).select(
        *evidence.columns, "source_kind", "policy_signal_type", "adjusted_weight", "counts"
    )


def weighted_evidence(evidence: DataFrame) -> DataFrame:
    """Adds source kind, policy signal type and adjusted weight; rows which do not count are gone."""
    # told without JSON first, so that such rows go before their text is looked at
    relevant = evidence.filter((F.col("relevance") != "LOW") | (policy.source_kind(F.col("source_type")) == "official"))
    return judged_evidence(relevant).filter("counts").drop("counts")


def scoring_evidence(evidence: DataFrame, keep: int = rules.EVIDENCE_KEEP) -> DataFrame:
    """The ``keep`` heaviest rows per role: weight, then day, then title, then item."""
    days = weighted_evidence(evidence).withColumn("published_day", F.to_date("published_at"))
    return top_k(days, ["role_slug"], heaviest(), keep, rank="evidence_rank")


def heaviest() -> list[Column]:
    return [
        F.col("adjusted_weight").desc(),
        F.col("published_day").desc(),
        by_name(F.col("title")).asc(),
        F.col("item_id").asc(),
    ]


def coverage_counts(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Public accepted items per role, decision and inference counted once, plus eligible hits.

    ``items``: source_url, decision_status, decision_slug, role_slug (inferred). ``candidates``:
    role_slug, source_url, timeline_eligible.
    """
    named = (
        items.filter((F.col("decision_status") == "ACCEPTED") & is_public(F.col("source_url")))
        .select(
            F.explode(
                F.array_distinct(
                    F.filter(F.array("decision_slug", "role_slug"), lambda s: s.isNotNull() & (s != ""))
                )
            ).alias("slug")
        )
    )
    hits = candidates.filter(F.col("timeline_eligible") & is_public(F.col("source_url"))).select(
        F.col("role_slug").alias("slug")
    )
    return named.unionByName(hits).groupBy("slug").agg(F.count("*").alias("coverage"))
