"""Score refresh: pool, evidence, content hash, a caller's scorer for changed roles, fallback."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.bind import bind, let
from tidemark.functions.hashing import stable_hash
from tidemark.functions.rates import band, clamp_rate, normalised_reasons
from tidemark.functions.text import collapse_space
from tidemark.functions.typed_json import json_integer, json_optional_text, json_string, json_text
from tidemark.operators.catalogue import with_profile
from tidemark.operators.evidence import evidence_pool, heaviest, judged_evidence
from tidemark.operators.ranking import ranked
from tidemark.plans.classify import BatchModel, run_model
from tidemark.session import cut_lineage

REASON = "struct<kind: string, title_en: string, title_zh: string, detail_en: string, detail_zh: string>"
SCORE_SCHEMA = (
    f"replacement_rate double, risk_band string, summary_en string, summary_zh string, reasons array<{REASON}>"
)
RISK_BANDS = ("low", "medium", "high", "severe")
REASON_KINDS = ("structure", "official", "media", "jobs")
#: What a scorer is told of a role, and what its hash covers, besides the evidence.
ROLE_FIELDS = (
    "slug", "name_en", "name_zh", "summary_en", "summary_zh", "keywords", "repetition_score", "rule_clarity_score",
    "transformation_score", "workflow_automation_score", "interpersonal_score", "physicality_score", "ambiguity_score",
)


def valid_score(json: Column) -> Column:
    """The parsed score where all fields have their types and closed values, else NULL."""
    r = F.from_json(json, SCORE_SCHEMA)

    def of_reason(x: Column) -> Column:
        return (
            json_string(x, "kind").isin(*REASON_KINDS) & json_text(x, "title_en") & json_text(x, "detail_en")
            & json_optional_text(x, "title_zh") & json_optional_text(x, "detail_zh")
        )

    def checked(v: Column) -> Column:
        reasons = F.try_variant_get(v, "$.reasons", "array<variant>")
        ok = (
            json_integer(v, "replacement_rate") & r["replacement_rate"].between(0, 100)
            & json_string(v, "risk_band").isin(*RISK_BANDS) & json_text(v, "summary_en")
            & json_optional_text(v, "summary_zh") & F.size(reasons).between(1, 5)
            & F.forall(reasons, lambda x: F.coalesce(of_reason(x), F.lit(False)))
        )
        return F.when(F.coalesce(ok, F.lit(False)), r)

    return let(F.try_parse_json(json), checked)


def cache_model(
    provider: Column, model: Column, cached_at: Column, now: datetime, preferred: str = rules.DEFAULT_MODEL,
    short_lived: tuple[str, ...] = rules.SHORT_LIVED_PROVIDERS, hours: int = rules.SCORE_CACHE_HOURS,
) -> Column:
    """Model name the cache is checked under.

    A score by a stand-in model counts under its own name while it is fresh, later under the
    preferred model's, which forces a new score.
    """
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(cached_at.cast("timestamp"))
    reuse = (F.length(model) > 0) & provider.isin(*short_lived) & (age <= hours * 3_600_000_000)
    return F.when(F.coalesce(reuse, F.lit(False)), model).otherwise(F.lit(preferred))


def evidence_lists(evidence: DataFrame) -> DataFrame:
    """Per role the ordered evidence list of at most eight and the size of its pool.

    The pool is dealt by role once: rows that do not count stay behind the others up to the count of the pool.
    """
    days = judged_evidence(evidence_pool(evidence)).withColumn("published_day", F.to_date("published_at"))
    rows = ranked(days, ["role_slug"], [F.col("counts").desc(), *heaviest()], "evidence_rank")
    kept = F.col("counts") & (F.col("evidence_rank") <= rules.EVIDENCE_KEEP)
    entry = F.struct(
        F.col("evidence_rank"), collapse_space(F.col("title")).alias("title"),
        F.col("source_kind"), F.col("policy_signal_type"), F.col("published_day").cast("string").alias("published_day"),
        collapse_space(F.col("summary_en")).alias("summary_en"),
        collapse_space(F.coalesce("inference_summary_en", F.lit(""))).alias("inference_summary_en"),
        F.col("impact"), F.col("relevance"), F.col("adjusted_weight"),
    )
    lists = rows.groupBy("role_slug").agg(
        F.count("*").alias("pool_size"), F.array_sort(F.collect_list(F.when(kept, entry))).alias("evidence"))
    return lists.withColumn("evidence", F.when(F.size("evidence") > 0, F.col("evidence")))


def with_score_hash(state: DataFrame, evidence: DataFrame, now: datetime, preferred: str = rules.DEFAULT_MODEL) -> DataFrame:
    """State rows with evidence, the hash of what a scorer would see, and ``unchanged``.

    ``state``: ROLE_FIELDS, risk_provider, risk_model, risk_cached_at, risk_input_hash, risk_prompt_version.
    """
    joined = state.join(evidence_lists(evidence).withColumnRenamed("role_slug", "slug"), "slug", "left")
    ready = bind(
        joined, model_key=cache_model(F.col("risk_provider"), F.col("risk_model"), F.col("risk_cached_at"), now, preferred),
        evidence_json=F.to_json(F.struct("evidence")), pool=F.coalesce("pool_size", F.lit(0)),
    )
    texts = ("summary_en", "summary_zh")
    digest = stable_hash(
        *[collapse_space(F.col(c)).alias(c) if c in texts else F.col(c) for c in ROLE_FIELDS],
        F.col("evidence_json"), F.lit(rules.SCORE_PROMPT_VERSION).alias("prompt_version"), F.col("model_key"),
    )
    hashed = bind(ready, score_hash=digest).drop("evidence", "pool_size")
    same = (
        (F.col("risk_input_hash") == F.col("score_hash"))
        & (F.col("risk_prompt_version") == rules.SCORE_PROMPT_VERSION)
        & (F.col("risk_model") == F.col("model_key"))
    )
    return hashed.withColumn("unchanged", F.coalesce(same, F.lit(False)))


def refresh_scores(state: DataFrame, evidence: DataFrame, scorer: BatchModel, now: datetime) -> DataFrame:
    """New score fields of every changed role; unchanged roles are not in the result.

    Each role goes to the scorer as one row: ROLE_FIELDS and its evidence as JSON. Where that fails, the role's
    dictionary profile stands in, counting the pool. The band always follows the clamped rate.
    """
    changed = cut_lineage(with_score_hash(state, evidence, now).filter(~F.col("unchanged")))
    answers = cut_lineage(run_model(changed, scorer, "slug", [*ROLE_FIELDS, "evidence_json"]))
    parsed = answers.select(
        "slug", "error", F.col("provider").alias("_provider"), F.col("model").alias("_model"),
        valid_score(F.col("result")).alias("_r"),
    )
    both = with_profile(changed, F.col("pool"), prefix="p_").join(parsed, "slug")
    r = F.col("_r")
    scored = bind(both, scored=F.col("error").isNull() & r.isNotNull())
    ok = F.col("scored")
    rate = F.when(ok, clamp_rate(r["replacement_rate"])).otherwise(F.col("p_replacement_rate"))
    return scored.select(
        "slug", rate.alias("replacement_rate"), band(rate).alias("risk_level"),
        F.when(ok, r["summary_en"]).otherwise(F.col("p_summary_en")).alias("risk_summary_en"),
        F.when(ok, F.coalesce(r["summary_zh"], r["summary_en"])).otherwise(F.col("p_summary_zh")).alias("risk_summary_zh"),
        F.when(ok, normalised_reasons(r["reasons"])).otherwise(F.col("p_reasons")).alias("risk_reasons"),
        F.when(ok, F.col("_provider")).otherwise("fallback").alias("risk_provider"),
        F.when(ok, F.col("_model")).otherwise("role-profile").alias("risk_model"),
        F.col("score_hash").alias("risk_input_hash"),
        F.lit(rules.SCORE_PROMPT_VERSION).alias("risk_prompt_version"),
        F.lit(now).alias("risk_cached_at"), F.lit("RATED").alias("rating_status"), F.lit(now).alias("last_rated_at"),
    )
