"""From classified items to stored rows: strategy, policy, decision, inference, signal, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import policy
from tidemark.functions.bind import bind
from tidemark.functions.hashing import item_hash
from tidemark.functions.text import trim_all
from tidemark.operators.ranking import top_k
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Persisted:
    items: DataFrame
    decisions: DataFrame
    inferences: DataFrame
    signals: DataFrame


def with_policy(classified: DataFrame) -> DataFrame:
    """Adds ``assigned_slug``, ``strategy`` and ``policy`` to classified items.

    Items of a direct mapped source fall back to the source's role.
    """
    c = F.col("c")
    assigned = F.coalesce(
        c["assigned_slug"], F.when(F.col("mapping_mode") == "direct_mapped", F.col("source_role_slug"))
    )
    bound = bind(
        classified, assigned_slug=assigned,
        strategy=policy.item_strategy(F.col("source_class"), F.col("source_type"), c["kind"], c["signal"]),
    )
    return bind(
        bound,
        policy=policy.signal_policy(
            F.col("source_class"), F.col("source_catalog_id"), F.col("assigned_slug"),
            F.col("strategy.default_signal_type"), F.col("strategy.can_affect_rate"), c["relevance"],
            c["weight_label"], c["kind"], c["signal"],
        ),
    )


def persist_rows(classified: DataFrame, state: DataFrame) -> Persisted:
    """The rows of the four tables; upserting them is the caller's next step."""
    # four tables are written from these rows, which cost matching and model calls
    rows = cut_lineage(with_policy(classified))
    c, s, p = F.col("c"), F.col("strategy"), F.col("policy")
    by_model = c["provider"].isNotNull() & c["model"].isNotNull()
    model_name = F.concat_ws(":", c["provider"], c["model"])
    own_hash = item_hash(
        F.col("source_catalog_id"), F.col("source_url"), F.col("source_type"), F.col("title"), F.col("summary"),
        F.col("hints"), F.col("candidate_slugs"), F.lit(rules.ITEM_PROMPT_VERSION), model_name,
    )
    items = rows.select(
        "item_id", "source_catalog_id", "source_url", "source_type", "title", F.col("summary").alias("summary_en"),
        F.lit(rules.MISSING_ZH_SUMMARY).alias("summary_zh"), "published_at",
        policy.mapping_mode(F.col("mapping_mode")).alias("mapping_mode"),
        F.when(by_model, own_hash).otherwise(F.col("input_hashes")[0]).alias("input_hash"),
        F.lit(rules.ITEM_PROMPT_VERSION).alias("prompt_version"),
        F.when(by_model, model_name).otherwise(F.lit(rules.DEFAULT_MODEL)).alias("model_name"),
    )
    decisions = rows.select(
        "item_id",
        policy.decision_status(F.when(F.col("assigned_slug").isNotNull(), "accepted").otherwise("unmatched")).alias("decision_status"),
        F.col("assigned_slug").alias("decision_slug"),
        policy.confidence(policy.confidence_of_relevance(c["relevance"])).alias("confidence"),
        c["explanation"].alias("reason"),
        F.when(F.col("mapping_mode") == "direct_mapped", "APPROVED").otherwise("PENDING").alias("review_status"),
    )
    raw = F.to_json(F.struct(
        c["assigned_slug"].alias("assignedRoleSlug"), c["kind"].alias("sourceKind"), c["signal"].alias("signalType"),
        c["relevance"].alias("relevance"), c["impact"].alias("impactDirection"), c["explanation"].alias("explanation"),
        c["summary_en"].alias("summaryEn"), c["summary_zh"].alias("summaryZh"), c["weight_label"].alias("signalWeight"),
        s["strategy_id"].alias("strategyId"), s["default_signal_type"].alias("strategyDefaultSignalType"),
        s["can_affect_rate"].alias("strategyCanAffectReplacementRate"), p["signal_type"].alias("normalizedSignalType"),
        p["signal_strength"].alias("normalizedSignalStrength"), p["signal_weight"].alias("normalizedSignalWeight"),
        p["keep_signal"].alias("shouldPersistSignal"),
    ), {"ignoreNullFields": "false"})
    inferences = rows.filter(by_model).select(
        "item_id", F.coalesce("assigned_slug", F.lit("unmapped")).alias("inferred_slug"),
        c["provider"].alias("provider"), c["model"].alias("model"), c["summary_en"].alias("summary_en"),
        F.coalesce(c["summary_zh"], c["summary_en"]).alias("summary_zh"),
        policy.impact_direction(c["impact"]).alias("impact"), policy.stored_relevance(c["relevance"]).alias("relevance"),
        p["signal_weight"].alias("signal_weight"), raw.alias("raw_json"),
    )
    signals = (
        rows.filter(p["keep_signal"] & F.col("assigned_slug").isNotNull())
        .join(state.select(F.col("slug").alias("assigned_slug")), "assigned_slug", "left_semi")
        .select(
            F.col("assigned_slug").alias("slug"), "source_url", "item_id", "title", "source_type",
            p["signal_type"].alias("signal_type"), p["signal_strength"].alias("strength"), "published_at",
            c["summary_en"].alias("summary_en"), c["explanation"].alias("rationale_en"),
        )
    )
    return Persisted(items, decisions, inferences, signals)


def source_summary(classified: DataFrame) -> DataFrame:
    """Fetched, cached, accepted and unmatched items per source."""
    assigned = F.col("assigned_slug").isNotNull()
    return with_policy(classified).groupBy("source_catalog_id").agg(
        F.count("*").alias("fetched"), F.count_if("cache_hit").alias("cached"),
        F.count_if(assigned).alias("accepted"), F.count_if(~assigned).alias("unmatched"),
    )


def accepted_per_role(classified: DataFrame) -> DataFrame:
    return (
        with_policy(classified)
        .filter(F.col("assigned_slug").isNotNull())
        .groupBy("source_catalog_id", "assigned_slug")
        .agg(F.count("*").alias("accepted"))
    )


def previews(classified: DataFrame, position: str, k: int = 3) -> DataFrame:
    """The first items of each source as one line each."""
    rows = with_policy(classified)
    word = F.when(F.col("cache_hit"), "cached").when(F.col("assigned_slug").isNotNull(), "accepted").otherwise("unmatched")
    line = F.concat_ws(
        ":", word, F.coalesce("assigned_slug", F.lit("none")), F.col("c.explanation"), trim_all(F.col("title"))
    )
    return top_k(rows, ["source_catalog_id"], [F.col(position).asc()], k, rank="preview_rank").select(
        "source_catalog_id", "preview_rank", line.alias("preview")
    )


def dry_run(probed: DataFrame) -> DataFrame:
    """Per source: items with a usable cache entry, and those a model would have to see."""
    return probed.groupBy("source_catalog_id").agg(
        F.count("*").alias("fetched"), F.count_if("cache_hit").alias("cached"),
        F.count_if(~F.col("cache_hit")).alias("would_classify"),
    )


def run_totals(items: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: fetched, observed, queued and persisted items, failed sources; fails if all failed.

    ``sources``: source_catalog_id, failed, one row per attempted source.
    """
    observed = F.col("mapping_mode") == "observe_only"
    counted = items.agg(
        F.count("*").alias("fetched"), F.count_if(observed).alias("observed"),
        F.count_if(observed).alias("queued"), F.count_if(~observed).alias("persisted"),
    )
    attempted = sources.agg(F.count("*")).scalar()
    failed = sources.agg(F.count_if("failed")).scalar()
    totals = counted.select("*", attempted.alias("attempted"), failed.alias("failed"))
    complaint = F.concat(
        F.lit("All attempted source fetches failed ("), F.col("failed").cast("string"), F.lit("/"),
        F.col("attempted").cast("string"), F.lit(")"),
    )
    all_failed = (F.col("attempted") > 0) & (F.col("failed") == F.col("attempted"))
    return totals.withColumn(
        "failed", F.when(all_failed, F.raise_error(complaint).cast("long")).otherwise(F.col("failed"))
    )
