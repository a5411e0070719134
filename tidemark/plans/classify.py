"""Classification of items: cache first, a caller's model for the rest, rules around both."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.hashing import collapsed_texts, item_hash
from tidemark.functions.bind import bind, let
from tidemark.functions.typed_json import json_optional_text, json_text, json_type
from tidemark.functions.policy import source_kind
from tidemark.functions.text import fold_ascii, has_workflow_language
from tidemark.operators.joins import dealt_join
from tidemark.operators.matching import hint_backed, matched_phrases, phrases_met
from tidemark.session import cut_lineage

CLASSIFICATION = (
    "assigned_slug", "kind", "signal", "relevance", "impact", "explanation", "summary_en", "summary_zh",
    "weight_label", "provider", "model",
)
# fields of a stored or generated classification, and the values the closed ones may take
RESULT_SCHEMA = (
    "assignedRoleSlug string, sourceKind string, signalType string, relevance string, impactDirection string, "
    "explanation string, summaryEn string, summaryZh string, signalWeight string"
)
ALLOWED = {
    "sourceKind": ("official", "media", "jobs", "other"),
    "signalType": ("capability_update", "adoption_case", "workflow_restructure", "hiring_shift", "ecosystem_context"),
    "relevance": ("high", "medium", "low", "none"),
    "impactDirection": ("increase", "decrease", "neutral"),
    "signalWeight": ("primary", "secondary", "supporting"),
}


# ---- context ---------------------------------------------------------------------------------
def with_candidates(items: DataFrame, candidates: DataFrame, lex: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Adds ``candidate_slugs`` in rank order, ``candidates`` (what a model is told of each) and ``top``.

    ``roles``: slug, name_en, name_zh; without it names are NULL. A candidate has slug, score, names, keywords and the
    keywords matched. Texts are shuffled by item only; a role with many items is dealt over parts.
    """
    phrases = lex.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("position", "phrase", "normal"))).alias("phrases"))
    if roles is None:
        named = phrases.withColumns({"name_en": F.lit(None).cast("string"), "name_zh": F.lit(None).cast("string")})
    else:
        named = phrases.join(roles.select("slug", "name_en", "name_zh"), "slug", "left")
    # at most twenty per item; kept, since their shares are measured and matching is dear
    slim = cut_lineage(candidates.select("item_id", "candidate_rank", "slug", "score"))
    listed = dealt_join(slim, named, "slug", ["item_id"], "left").groupBy(
        "item_id").agg(F.array_sort(F.collect_list(
            F.struct("candidate_rank", "slug", "score", "name_en", "name_zh", "phrases"))).alias("_c"))
    folded = bind(
        items.join(listed, "item_id", "left"), _t=fold_ascii(F.col("title")), _s=fold_ascii(F.col("summary")),
        _h=fold_ascii(F.array_join("hints", " ")), _n=F.array_distinct(F.flatten(F.transform("_c", lambda c: c["phrases"]["normal"]))),
    )
    # candidates share phrases: each distinct one is looked up in the texts once
    met = bind(folded, _met=phrases_met(F.col("_t"), F.col("_s"), F.col("_h"), F.col("_n")))
    told = F.transform("_c", lambda c: F.struct(
        c["slug"].alias("slug"), c["score"].alias("score"), c["name_en"].alias("name_en"), c["name_zh"].alias("name_zh"),
        c["phrases"]["phrase"].alias("keywords"),
        matched_phrases(F.col("_met.near"), F.col("_met.late"), c["phrases"]).alias("matched")))
    bound = bind(met, candidates=told)
    top = F.get("candidates", 0)
    return bound.withColumns({
        "candidate_slugs": F.coalesce(F.transform("candidates", lambda c: c["slug"]), F.array().cast("array<string>")),
        "top": F.when(top.isNotNull(), F.struct(top["slug"].alias("slug"), top["score"].alias("score"), top["matched"].alias("matched"))),
    }).drop("_c", "_t", "_s", "_h", "_n", "_met")


def with_input_hashes(items: DataFrame, models: Sequence[str]) -> DataFrame:
    """``input_hashes``, one per usable model name, the preferred one first."""
    title, summary, hints = collapsed_texts(F.col("title"), F.col("summary"), F.col("hints"))
    bound = bind(items, _title=title, _summary=summary, _hints=hints)
    hashes = [
        item_hash(
            F.col("source_catalog_id"), F.col("source_url"), F.col("source_type"), F.col("_title"), F.col("_summary"),
            F.col("_hints"), F.col("candidate_slugs"), F.lit(rules.ITEM_PROMPT_VERSION), F.lit(m), collapsed=True,
        )
        for m in models
    ]
    return bound.withColumn("input_hashes", F.array(*hashes)).drop("_title", "_summary", "_hints")


def probe_cache(items: DataFrame, stored: DataFrame, models: Sequence[str]) -> DataFrame:
    """Adds ``cached`` (the stored row) and ``cache_hit``.

    ``stored``: source_catalog_id, source_url, input_hash, prompt_version, model_name, and the
    inference and decision fields. A hit needs the same input, prompt version and a usable model.
    """
    side = stored.select(
        "source_catalog_id", "source_url",
        F.struct(*[c for c in stored.columns if c not in ("source_catalog_id", "source_url")]).alias("cached"),
    )
    joined = items.join(side, ["source_catalog_id", "source_url"], "left")
    c = F.col("cached")
    hit = (
        F.array_contains("input_hashes", c["input_hash"])
        & (c["prompt_version"] == rules.ITEM_PROMPT_VERSION)
        & c["model_name"].isin(*models)
        & c["has_inference"]
        & c["has_decision"]
    )
    return joined.withColumn("cache_hit", F.coalesce(hit, F.lit(False)))


# ---- validation and rebuilding ---------------------------------------------------------------
def valid_result(json: Column) -> Column:
    """The parsed classification where every field is a text as it must be, else NULL.

    The role must be given, though it may be null; the Chinese summary may be left out.
    """
    r = F.from_json(json, RESULT_SCHEMA)

    def checked(v: Column) -> Column:
        ok = json_text(v, "explanation") & json_text(v, "summaryEn")
        ok = ok & (json_text(v, "assignedRoleSlug") | (json_type(v, "assignedRoleSlug") == "VOID"))
        ok = ok & json_optional_text(v, "summaryZh")
        for field, values in ALLOWED.items():
            ok = ok & json_text(v, field) & r[field].isin(*values)
        return F.when(F.coalesce(ok, F.lit(False)), r)

    return let(F.try_parse_json(json), checked)


def _row(values: dict[str, Column]) -> Column:
    return F.struct(*[values[n].cast("string").alias(n) for n in CLASSIFICATION])


def of_result(r: Column, provider: Column, model: Column) -> Column:
    return _row({
        "assigned_slug": r["assignedRoleSlug"], "kind": r["sourceKind"], "signal": r["signalType"],
        "relevance": r["relevance"], "impact": r["impactDirection"], "explanation": r["explanation"],
        "summary_en": r["summaryEn"], "summary_zh": r["summaryZh"], "weight_label": r["signalWeight"],
        "provider": provider, "model": model,
    })


def of_stored(source_type: Column, c: Column) -> Column:
    """Rebuilt from the stored columns where the stored JSON is not a valid classification."""
    slug = F.when((c["decision_status"] != "UNMATCHED") & (c["inferred_slug"] != "unmapped"), c["inferred_slug"])
    relevance = (
        F.when(c["relevance"] == "HIGH", "high").when(c["relevance"] == "MEDIUM", "medium")
        .when(slug.isNotNull(), "low").otherwise("none")
    )
    impact = F.when(c["impact"] == "INCREASE", "increase").when(c["impact"] == "DECREASE", "decrease").otherwise("neutral")
    label = F.when(c["signal_weight"] >= 0.75, "primary").when(c["signal_weight"] >= 0.45, "secondary").otherwise("supporting")
    return _row({
        "assigned_slug": slug, "kind": source_kind(source_type), "signal": F.lit("ecosystem_context"),
        "relevance": relevance, "impact": impact, "explanation": c["reason"], "summary_en": c["summary_en"],
        "summary_zh": F.nullif(c["summary_zh"], F.lit("")), "weight_label": label, "provider": c["provider"],
        "model": c["model"],
    })


def _unmatched(kind: Column, explanation: Column, summary: Column, zh: Column, provider: Column, model: Column) -> Column:
    return _row({
        "assigned_slug": F.lit(None), "kind": kind, "signal": F.lit("ecosystem_context"), "relevance": F.lit("none"),
        "impact": F.lit("neutral"), "explanation": explanation, "summary_en": summary, "summary_zh": zh,
        "weight_label": F.lit("supporting"), "provider": provider, "model": model,
    })


# ---- promotion -------------------------------------------------------------------------------
def promotes_top(workflow: Sequence[str], aliased: Sequence[str]) -> Column:
    """Whether the top candidate takes an item the model left unassigned."""
    text = F.concat("title", F.lit(" "), "summary")
    top = F.col("top")
    n, score = F.size(top["matched"]), top["score"]
    easy = F.col("source_type").isin("COMPANY_UPDATE", "BLOG", "JOB_POSTING")
    backed = hint_backed(top["matched"], F.col("hints"))

    def at_least(if_easy: float, otherwise: float) -> Column:
        return score >= F.when(easy, if_easy).otherwise(otherwise)

    with_alias = (backed & (score >= 3)) | (n >= 2) | ((n >= 1) & at_least(6.0, 9.0))
    plain = ((n >= 1) & at_least(3.5, 5.5)) | (backed & at_least(4.0, 5.0)) | (n >= 2)
    # workflow words are needed in any case, and with them broad news may pass
    concrete = has_workflow_language(text, workflow)
    chosen = F.when(top["slug"].isin(*aliased), with_alias).otherwise(plain)
    return F.coalesce(top.isNotNull() & concrete & chosen, F.lit(False))


# ---- model -----------------------------------------------------------------------------------
BatchModel = Callable[[pd.DataFrame], pd.DataFrame]


def run_model(rows: DataFrame, model: BatchModel, key: str, columns: Sequence[str]) -> DataFrame:
    """Feeds rows to a caller's function in batches: columns in; key, result, provider, model out.

    A batch which fails is tried again in halves, so that one bad row costs few repeated answers; rows which fail
    alone come out with the error text.
    """
    key_type = rows.schema[key].dataType.simpleString()
    out_names = [key, "result", "provider", "model", "error"]

    def attempt(batch: pd.DataFrame) -> pd.DataFrame:
        done, failed, waiting = [], [], [batch]
        while waiting:
            part = waiting.pop()
            try:
                out = model(part)
                done.append(out.assign(error=None)[out_names])
            except Exception as exc:  # the caller's function may raise anything
                middle = len(part) // 2
                if middle:
                    waiting += [part.iloc[middle:], part.iloc[:middle]]
                else:
                    failed.append((part[key].to_list()[0], None, None, None, str(exc)))
        # put together once, not after every halving
        if failed:
            done.append(pd.DataFrame(failed, columns=out_names, dtype=object))
        return done[0] if len(done) == 1 else pd.concat(done)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield attempt(batch)

    return rows.select(key, *[c for c in columns if c != key]).mapInPandas(
        run, f"{key} {key_type}, result string, provider string, model string, error string"
    )


def classify(
    items: DataFrame,
    model: BatchModel,
    workflow: Sequence[str] = rules.WORKFLOW_TERMS,
    aliased: Sequence[str] = tuple(rules.ROLE_ALIASES),
) -> DataFrame:
    """Adds ``c``, the classification of every item, and ``route``.

    ``items`` come from ``probe_cache``. Only rows with candidates and without a usable cache entry
    reach the model.
    """
    texts = rules.CLASSIFY_TEXTS
    none = F.lit(None).cast("string")
    no_candidates = F.size("candidate_slugs") == 0
    c = F.col("cached")
    from_cache = F.when(
        F.col("cache_hit"),
        F.coalesce(
            F.when(valid_result(c["raw_json"]).isNotNull(), of_result(valid_result(c["raw_json"]), c["provider"], c["model"])),
            of_stored(F.col("source_type"), c),
        ),
    )
    unmatched = _unmatched(
        source_kind(F.col("source_type")), F.lit(texts["no_candidate"][0]), F.lit(texts["no_candidate"][1]), none, none, none
    )
    # matching and probing are behind this; kept, so that neither runs again for the join with the answers
    settled = cut_lineage(bind(items, c=F.when(no_candidates, unmatched).otherwise(from_cache)))
    open_rows = settled.filter(F.col("c").isNull())
    # answers are paid for: kept in the shared folder, so nothing asks the model twice
    asked = cut_lineage(run_model(
        open_rows, model, "item_id", ["item_id", "source_type", "title", "summary", "hints", "candidate_slugs", "candidates"]
    )).select(
        "item_id", valid_result(F.col("result")).alias("_r"), F.col("provider").alias("_provider"),
        F.col("model").alias("_model"),
        F.coalesce("error", F.when(valid_result(F.col("result")).isNull(), "invalid model output")).alias("_error"),
        F.lit(True).alias("_asked"),
    )
    r, top = F.col("_r"), F.col("top")
    promoted = promotes_top(workflow, aliased)
    note = F.concat(F.lit(texts["promoted"][0]), top["slug"], F.lit(texts["promoted"][1]))
    generated = of_result(r, F.col("_provider"), F.col("_model"))
    lifted = generated.withField("assigned_slug", top["slug"]).withField(
        "relevance", F.when(r["relevance"] == "none", "low").otherwise(r["relevance"])
    ).withField("explanation", F.concat(r["explanation"], note))
    outside = _unmatched(
        r["sourceKind"], F.concat(F.lit(texts["outside"][0]), r["assignedRoleSlug"], F.lit(texts["outside"][1])),
        F.lit(texts["outside"][2]), none, F.col("_provider"), F.col("_model"),
    )
    failure = _unmatched(
        source_kind(F.col("source_type")), F.concat(F.lit(texts["error"][0]), F.col("_error")), F.lit(texts["error"][1]),
        F.lit(texts["error"][2]), F.lit("fallback"), F.lit("classification-fallback"),
    )
    failed_lifted = (
        failure.withField("assigned_slug", top["slug"]).withField("relevance", F.lit("low"))
        .withField("explanation", F.concat(F.lit(texts["error"][0]), F.col("_error"), note))
        .withField("summary_en", F.lit(texts["error_promoted"][0]))
        .withField("summary_zh", F.lit(texts["error_promoted"][1]))
    )
    inside = F.array_contains("candidate_slugs", r["assignedRoleSlug"])
    by_model = (
        F.when(F.col("_error").isNotNull(), F.when(F.col("_promoted"), failed_lifted).otherwise(failure))
        .when(r["assignedRoleSlug"].isNull(), F.when(F.col("_promoted"), lifted).otherwise(generated))
        .when(inside, generated)
        .otherwise(outside)
    )
    route = (
        F.when(no_candidates, "no_candidate").when(F.col("_asked").isNull(), "cache")
        .when(F.col("_error").isNotNull(), "error")
        .when(r["assignedRoleSlug"].isNull(), F.when(F.col("_promoted"), "promoted").otherwise("unassigned"))
        .when(inside, "model").otherwise("outside")
    )
    joined = bind(settled.join(asked, "item_id", "left"), _promoted=promoted)
    return joined.withColumns({"c": F.coalesce("c", by_model), "route": route}).drop(
        "_r", "_provider", "_model", "_error", "_promoted", "_asked"
    )
