"""Classification, persistence, score refresh and regression runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import matching as mt
from tidemark.plans import classify as cl
from tidemark.plans import ingest, refresh, regression
from tidemark.session import cut_lineage
from tidemark.workload.catalogue import profile_roles, profile_sql
from tidemark.workload.evidence import WEIGHTED
from tidemark.workload.matching import GATED, candidates, lex
from tidemark.workload.registry import Inputs, query
from tidemark.workload.text import FX_NOISE, FX_WORKFLOW, _gate_sql

MODELS = (rules.DEFAULT_MODEL, f"primary:{rules.DEFAULT_MODEL}")


def contexts(t: Inputs):
    items = t.fx_item.withColumn("hints", F.split("hint_text", " "))
    return cl.with_input_hashes(cl.with_candidates(items, candidates(t), lex(t), t.fx_role), MODELS)


def stored_rows(ctx):
    """A stored cache with usable, stale, outdated and missing entries."""
    case = F.col("item_id") % 5
    valid = F.to_json(F.struct(
        F.lit("r7").alias("assignedRoleSlug"), F.lit("official").alias("sourceKind"), F.lit("adoption_case").alias("signalType"),
        F.lit("medium").alias("relevance"), F.lit("increase").alias("impactDirection"), F.lit("why").alias("explanation"),
        F.lit("what").alias("summaryEn"), F.lit("secondary").alias("signalWeight"),
    ))
    return ctx.filter(F.col("lang") != "fr").select(
        "source_catalog_id", "source_url",
        F.when(case == 0, F.col("input_hashes")[0]).when(case == 2, F.col("input_hashes")[1]).otherwise("stale").alias("input_hash"),
        F.when(case == 3, "2020-01-01").otherwise(rules.ITEM_PROMPT_VERSION).alias("prompt_version"),
        F.when(case == 2, MODELS[1]).otherwise(MODELS[0]).alias("model_name"),
        F.lit(True).alias("has_inference"), (F.col("source") != "src11").alias("has_decision"),
        F.when(F.col("source_type") == "BLOG", valid).otherwise('{"assignedRoleSlug": 3}').alias("raw_json"),
        F.when(F.col("source_type") == "NEWS", "UNMATCHED").otherwise("ACCEPTED").alias("decision_status"),
        F.when(F.col("source_type") == "JOB_POSTING", "unmapped").otherwise("r9").alias("inferred_slug"),
        F.lit("HIGH").alias("relevance"), F.lit("MAINTAIN").alias("impact"), F.lit("stored reason").alias("reason"),
        F.lit("stored").alias("summary_en"), F.lit("").alias("summary_zh"), F.lit(0.5).alias("signal_weight"),
        F.lit("prov").alias("provider"), F.lit("mod").alias("model"),
    )


def probed(t: Inputs):
    ctx = cut_lineage(contexts(t))  # read twice: as the input and as what the stored rows derive from
    return cl.probe_cache(ctx, stored_rows(ctx), MODELS)


def stub_model(batch):
    """Stands in for a model: first candidate, nothing, a role outside the set, or an error."""
    import json

    import pandas as pd

    if (batch["item_id"] % 4 == 3).any():
        raise ValueError("model is down")

    def answer(item_id, slugs, told):
        slug = {0: slugs[0], 1: None, 2: "r-outside"}[item_id % 4]
        first = told[0]
        seen = f"{first['name_en']}/{first['name_zh']}/{len(first['keywords'])}/{len(first['matched'])}/{first['score']:.1f}"
        return json.dumps({
            "assignedRoleSlug": slug, "sourceKind": "official", "signalType": "adoption_case",
            "relevance": "none" if slug is None else "high", "impactDirection": "increase", "explanation": seen,
            "summaryEn": "short", "summaryZh": None, "signalWeight": "primary",
        })

    results = [answer(i, list(s), c) for i, s, c in zip(batch["item_id"], batch["candidate_slugs"], batch["candidates"])]
    return pd.DataFrame({"item_id": batch["item_id"], "result": results, "provider": "stub", "model": "m"})


HIT_SQL = """(item_id % 5 in (0, 2) and lang <> 'fr' and source <> 'src11')"""
ROUTED = f"""{GATED},
tops as (select item_id, score, matched from cand where candidate_rank = 1),
slugs as (select item_id, max(slug) filter (candidate_rank = 1) as top_slug from cand group by item_id),
ctx as (select i.*, t.score, t.matched, s.top_slug, {HIT_SQL} as hit,
          regexp_matches(title || ' ' || summary, '{_gate_sql(FX_WORKFLOW)}') and (matched >= 2 or (matched >= 1 and score >=
             case when source_type = 'NEWS' then 5.5 else 3.5 end)) as lifts
        from fx_item i left join tops t using (item_id) left join slugs s using (item_id)),
rt as (select *, case when top_slug is null then 'no_candidate' when hit then 'cache' when item_id % 4 = 3 then 'error'
          when item_id % 4 = 1 then case when lifts then 'promoted' else 'unassigned' end
          when item_id % 4 = 0 then 'model' else 'outside' end as route from ctx),
cls as (select *, case route when 'cache' then case source_type when 'BLOG' then 'r7' when 'COMPANY_UPDATE' then 'r9' end
          when 'model' then top_slug when 'promoted' then top_slug when 'error' then case when lifts then top_slug end end as assigned_slug,
        case route when 'cache' then case when source_type = 'BLOG' then 'medium' else 'high' end when 'model' then 'high' when 'promoted' then 'low'
          when 'error' then case when lifts then 'low' else 'none' end else 'none' end as relevance from rt)"""


@query("J8_cache_probe", f"with ctx as (select * from fx_item) select item_id, {HIT_SQL} as cache_hit from ctx")
def j8(t: Inputs):
    return probed(t).select("item_id", "cache_hit")


@query("I23_dry_run", f"""
select source_catalog_id, count(*) as fetched, count(*) filter ({HIT_SQL}) as cached, count(*) filter (not {HIT_SQL}) as would_classify
from fx_item group by source_catalog_id""")
def i23(t: Inputs):
    return ingest.dry_run(probed(t))


def classified(t: Inputs):
    rows = cl.classify(probed(t), stub_model, workflow=FX_WORKFLOW)
    kind = F.when(F.col("source_type").isin("COMPANY_UPDATE", "BLOG"), "official").when(
        F.col("source_type") == "JOB_POSTING", "jobs").otherwise("media")
    direct = F.col("source_catalog_id") == "src3"
    return rows.withColumns({
        "source_class": kind, "mapping_mode": F.when(direct, "direct_mapped").otherwise("observe_only"),
        "source_role_slug": F.when(direct, "r3"),
    })


@query("I4_classification", f"with {ROUTED} select item_id, route, assigned_slug, relevance from cls")
def i4(t: Inputs):
    return cl.classify(probed(t), stub_model, workflow=FX_WORKFLOW).select(
        "item_id", "route", F.col("c.assigned_slug").alias("assigned_slug"), F.col("c.relevance").alias("relevance")
    )


FINAL = f"""{ROUTED},
fin as (select *, coalesce(assigned_slug, case when source_catalog_id = 'src3' then 'r3' end) as slug,
   (route = 'model' and source_type <> 'JOB_POSTING') or (route = 'cache' and source_type = 'BLOG') as keeps from cls)"""


@query("I5_persisted_rows", f"""
with {FINAL}
select item_id, case when slug is null then 'UNMATCHED' else 'ACCEPTED' end as decision_status, slug as decision_slug,
  case when relevance in ('high', 'medium', 'low') then upper(relevance) end as confidence,
  case when source_catalog_id = 'src3' then 'APPROVED' else 'PENDING' end as review_status,
  case when source_catalog_id = 'src3' then 'DIRECT_MAPPED' else 'OBSERVE_ONLY' end as mapping_mode,
  case when route <> 'no_candidate' then coalesce(slug, 'unmapped') end as inferred_slug,
  keeps and slug in (select slug from fx_state) as signal_kept
from fin""")
def i5(t: Inputs):
    p = ingest.persist_rows(classified(t), t.fx_state)
    kept = p.signals.select("item_id", F.lit(True).alias("signal_kept"))
    return (
        p.items.select("item_id", "mapping_mode")
        .join(p.decisions.drop("reason"), "item_id")
        .join(p.inferences.select("item_id", "inferred_slug"), "item_id", "left")
        .join(kept, "item_id", "left")
        .withColumn("signal_kept", F.coalesce("signal_kept", F.lit(False)))
    )


@query("A3_source_summary", f"""
with {FINAL}
select source_catalog_id, count(*) as fetched, count(*) filter (hit) as cached, count(*) filter (slug is not null) as accepted,
       count(*) filter (slug is null) as unmatched from fin group by source_catalog_id""")
def a3(t: Inputs):
    return ingest.source_summary(classified(t))


@query("A3_accepted_per_role", f"""
with {FINAL} select source_catalog_id, slug as assigned_slug, count(*) as accepted from fin where slug is not null group by 1, 2""")
def a3_roles(t: Inputs):
    return ingest.accepted_per_role(classified(t))


@query("A3_previews", f"""
with {FINAL}, r as (select *, row_number() over (partition by source_catalog_id order by item_id) as preview_rank from fin)
select source_catalog_id, preview_rank, case when hit then 'cached' when slug is not null then 'accepted' else 'unmatched' end as word,
   coalesce(slug, 'none') as slug from r where preview_rank <= 3""")
def a3_previews(t: Inputs):
    p = ingest.previews(classified(t), "item_id")
    parts = F.split("preview", ":")
    return p.select(
        "source_catalog_id", F.col("preview_rank").cast("long").alias("preview_rank"), parts[0].alias("word"), parts[1].alias("slug")
    )


@query("A4_run_totals", """
select count(*) as fetched, count(*) filter (source_catalog_id <> 'src3') as observed, count(*) filter (source_catalog_id <> 'src3') as queued,
  count(*) filter (source_catalog_id = 'src3') as persisted, (select count(distinct source) from documents) as attempted,
  (select count(distinct source) from documents where source like 'src1%') as failed from fx_item""")
def a4(t: Inputs):
    items = t.fx_item.withColumn(
        "mapping_mode", F.when(F.col("source_catalog_id") == "src3", "direct_mapped").otherwise("observe_only")
    )
    sources = t.documents.select(F.col("source").alias("source_catalog_id")).distinct().withColumn(
        "failed", F.startswith("source_catalog_id", F.lit("src1"))
    )
    return ingest.run_totals(items, sources)


@query("P35_valid_output", """
select item_id, source_type <> 'JOB_POSTING' and relevance <> 'LOW' and impact <> 'MAINTAIN' as valid,
   case when source_type <> 'JOB_POSTING' and relevance <> 'LOW' and impact <> 'MAINTAIN' then decision_slug end as slug from fx_evidence""")
def p35(t: Inputs):
    # no summary for job postings, an unknown relevance for LOW, a number in place of a text for MAINTAIN
    text = F.to_json(F.struct(
        F.col("decision_slug").alias("assignedRoleSlug"), F.lit("official").alias("sourceKind"),
        F.lit("adoption_case").alias("signalType"),
        F.when(F.col("relevance") == "LOW", "huge").otherwise(F.lower("relevance")).alias("relevance"),
        F.when(F.col("impact") == "MAINTAIN", "neutral").otherwise(F.lower("impact")).alias("impactDirection"),
        F.lit("why").alias("explanation"),
        F.when(F.col("source_type") == "JOB_POSTING", "").otherwise("what").alias("summaryEn"),
        F.lit(None).cast("string").alias("summaryZh"), F.lit("primary").alias("signalWeight"),
    ), {"ignoreNullFields": "false"})
    json = F.when(F.col("impact") == "MAINTAIN", F.replace(text, F.lit('"why"'), F.lit("5"))).otherwise(text)
    r = cl.valid_result(F.col("json"))
    return t.fx_evidence.select("item_id", json.alias("json")).select(
        "item_id", r.isNotNull().alias("valid"), r["assignedRoleSlug"].alias("slug")
    )


NOW = datetime(2024, 2, 1)


def state_with_cache(t: Inputs):
    """State rows with names, keywords and cache columns."""
    keywords = profile_roles(t).select("slug", "keywords")
    provider = F.when(F.col("s_rules") == 0, "fallback").when(F.col("s_rules") == 1, "minimax").otherwise("primary")
    return (
        t.fx_state.join(keywords, "slug", "left")
        .withColumns({
            "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
            "risk_provider": provider,
            "risk_model": F.when(F.col("s_rules") < 2, "stand-in").otherwise(rules.DEFAULT_MODEL),
            "risk_prompt_version": F.lit(rules.SCORE_PROMPT_VERSION),
            "risk_input_hash": F.lit(None).cast("string"),
            "summary_en": F.col("risk_summary_en"), "summary_zh": F.col("risk_summary_zh"),
        })
        .withColumnsRenamed({
            "s_repetition": "repetition_score", "s_transformation": "transformation_score",
            "s_workflow": "workflow_automation_score", "s_interpersonal": "interpersonal_score",
            "s_physical": "physicality_score", "s_ambiguity": "ambiguity_score",
        })
        .withColumn("rule_clarity_score", F.col("s_rules"))
    )


@query("I9_cache_model", f"""
select slug, case when s_rules < 2 and risk_cached_at is not null and epoch_us(timestamp '2024-02-01') - epoch_us(risk_cached_at) <= 21600000000
   then 'stand-in' else '{rules.DEFAULT_MODEL}' end as model_key from fx_state""")
def i9(t: Inputs):
    s = state_with_cache(t)
    key = refresh.cache_model(F.col("risk_provider"), F.col("risk_model"), F.col("risk_cached_at"), NOW)
    return s.select("slug", key.alias("model_key"))


def stub_scorer(batch):
    """Stands in for a scorer: a rate by the number of evidence rows, an error for some names."""
    import json

    import pandas as pd

    if batch["name_en"].str.startswith("old").any():
        raise ValueError("scorer is down")

    def answer(text, words, repetition):
        n = len(json.loads(text).get("evidence") or [])
        # some answers are no valid score: a fraction, an unknown kind of reason, an empty title
        rate = n * 13 + (0.5 if n == 3 else 0)
        reason = {"kind": "rumour" if n == 5 else "media", "title_en": "" if n == 2 else "t", "detail_en": "d"}
        return json.dumps({"replacement_rate": rate, "risk_band": "low", "summary_en": f"{n} items, {len(words)} words, {repetition}",
                           "summary_zh": None, "reasons": [reason]})

    rows = zip(batch["evidence_json"], batch["keywords"], batch["repetition_score"])
    return pd.DataFrame({"slug": batch["slug"], "result": [answer(*x) for x in rows],
                         "provider": "stub", "model": "s1"})


I8_SQL = f"""
with {WEIGHTED.replace('from fx_evidence', 'from (select * from fx_evidence where item_id in (select item_id from pool))').replace('typed as', f'''
  ra as (select item_id, role_slug, not starts_with(source_catalog_id, 'discovery-') as prim,
    row_number() over (partition by role_slug order by published_at desc, item_id) as rn_all from fx_evidence),
  rp as (select item_id, row_number() over (partition by role_slug order by published_at desc, item_id) as rn_p from ra
         join fx_evidence using (item_id, role_slug) where prim),
  pool as (select ra.item_id, ra.role_slug from ra left join rp using (item_id) where rn_all <= 24 or rn_p <= 64), typed as''', 1)},
n8 as (select role_slug, least(8, count(*)) as n from kept group by role_slug),
ps as (select role_slug, count(*) as pool from pool group by role_slug),
pr as (select s.slug, s.name_en, s.s_repetition, p.i_rate, p.cnt, coalesce(len(string_split(p.kw_text, ' ')), 0) as nk from fx_state s left join
   (select * from {profile_sql("(select r.*, coalesce(pool, 0) as pc from (select slug, name_en, name_zh, industry_code, is_active, concat(kw_text, case when name_en like '%ring' then ' software' when name_en like '%bolt' then ' field repair' when name_en like '%plate' then ' sales managers' when name_en like '%rod' then ' data entry' else '' end) as kw_text from fx_role) r left join ps on r.slug = ps.role_slug)", "pc")}) p on s.slug = p.slug),
x as (select pr.slug, pr.name_en, s_repetition, nk, coalesce(n, 0) as n, coalesce(i_rate, 34) as i_rate,
   name_en like 'old%' or coalesce(n, 0) in (2, 3, 5, 8) as refused from pr left join n8 on pr.slug = n8.role_slug),
y as (select slug, case when refused then i_rate else cast(least(95, greatest(5, n * 13)) as int) end as replacement_rate,
   case when refused then 'role-profile' else 's1' end as risk_model,
   case when not refused then concat(n, ' items, ', nk, ' words, ', s_repetition) end as scored_summary from x)
select slug, replacement_rate, case when replacement_rate >= 80 then 'SEVERE' when replacement_rate >= 55 then 'HIGH'
  when replacement_rate >= 30 then 'MEDIUM' else 'LOW' end as risk_level, risk_model, scored_summary from y
"""


@query("I8_score_refresh", I8_SQL)
def i8(t: Inputs):
    out = refresh.refresh_scores(state_with_cache(t), t.fx_evidence, stub_scorer, NOW)
    scored = F.col("risk_model") == "s1"
    return out.select(
        "slug", "replacement_rate", "risk_level", "risk_model", F.when(scored, F.col("risk_summary_en")).alias("scored_summary")
    )


@query("I24_regression_report", """
select l.doc_id as id, d.n_chars / 50 between 10 and 60 as in_range,
   case when least(95, greatest(5, floor(d.n_chars / 50.0 + 0.5))) >= 55 then 'high' else 'low' end = case when quality = 1 then 'high' else 'low' end as band_ok
from labels l join documents d using (doc_id)""")
def i24(t: Inputs):
    cases = t.labels.select(
        F.col("doc_id").alias("id"), F.lit(10).alias("expectedReplacementRateMin"), F.lit(60).alias("expectedReplacementRateMax"),
        F.when(F.col("quality") == 1, "high").otherwise("low").alias("expectedRiskBand"),
    )
    from tidemark.functions.rates import clamp_rate

    rate = F.col("n_chars") / 50
    scores = t.documents.select(
        F.col("doc_id").alias("id"), rate.alias("replacement_rate"),
        F.when(clamp_rate(rate) >= 55, "high").otherwise("low").alias("risk_band"),
    )
    return regression.score_report(cases, scores).select("id", "in_range", "band_ok")


@query("I24_attribution_report", f"""
with {ROUTED}, e as (select item_id as id, case when item_id % 3 = 0 then top_slug when item_id % 3 = 1 then 'r-outside' end as expected,
  assigned_slug as actual from cls)
select id, expected, actual, expected is not distinct from actual as ok from e""")
def i24_attribution(t: Inputs):
    rows = cut_lineage(cl.classify(probed(t), stub_model, workflow=FX_WORKFLOW).select("item_id", "candidate_slugs", "c"))
    case = F.col("item_id") % 3
    cases = rows.select(
        F.col("item_id").alias("id"), F.when(case == 0, F.get("candidate_slugs", 0)).when(case == 1, "r-outside").alias(
            "expectedAssignedRoleSlug"))
    return regression.attribution_report(cases, rows).select("id", "expected", "actual", "ok")


@query("U1_injected_scorer", f"select slug, risk_model, scored_summary from ({I8_SQL})")
def u1(t: Inputs):
    return i8(t).select("slug", "risk_model", "scored_summary")


@query("U2_injected_classifier", f"""
with {ROUTED}, nk as (select slug, count(*) as kw from lexi group by slug)
select item_id, concat(r.name_en, '/', r.name_zh, '/', kw, '/', least(6, matched), '/', printf('%.1f', score)) as told
from cls join fx_role r on r.slug = top_slug join nk on nk.slug = top_slug where route = 'model'""")
def u2(t: Inputs):
    routed = cl.classify(probed(t), stub_model, workflow=FX_WORKFLOW)
    return routed.filter(F.col("route") == "model").select("item_id", F.col("c.explanation").alias("told"))


@query("I24_cases_from_files", """
with c as (select l.doc_id as id, coalesce(d.n_chars, 0) / 50 as rate, case when quality = 1 then 'high' else 'low' end as band,
   case doc_id % 3 when 0 then 'HIRING_SHIFT' when 1 then 'TOOLING' else 'ADOPTION' end as signal from labels l join documents d using (doc_id)
   where exists (select 1 from fx_role where slug = concat('r', l.doc_id % 500 + 1)))
select cast(id as varchar) as id, concat('r', id % 500 + 1) as role_slug, signal, rate between 10 and 60 as in_range,
   case when least(95, greatest(5, floor(rate + 0.5))) >= 55 then 'high' else 'low' end = band as band_ok from c""")
def i24_files(t: Inputs):
    from tidemark.functions.rates import clamp_rate
    from tidemark.session import new_state_dir

    case = F.col("doc_id") % 3
    evidence = F.struct(
        F.lit("Source").alias("sourceLabel"), F.when(case == 0, "jobs").otherwise("NEWS").alias("sourceType"), F.lit("2024-01-01").alias("publishedAt"),
        F.lit("title").alias("title"), F.lit("text").alias("summaryEn"), F.when(case == 1, "neutral").otherwise("increase").alias("impactDirection"))
    written = t.labels.join(t.documents.select("doc_id"), "doc_id").select(F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("r"), (F.col("doc_id") % 500 + 1).cast("string")).alias("roleSlug"),
        F.lit(10).alias("expectedReplacementRateMin"), F.lit(60).alias("expectedReplacementRateMax"),
        F.when(F.col("quality") == 1, "high").otherwise("low").alias("expectedRiskBand"), F.array(evidence).alias("items"))).alias("value"))
    path = new_state_dir(t.spark, "score-cases")
    written.write.text(path)
    cases = regression.read_cases(t.spark, path, regression.SCORE_CASE, whole_files=False)
    known = regression.score_inputs(
        cases.join(t.fx_role.select(F.col("slug").alias("roleSlug")), "roleSlug", "left_semi"), t.fx_role.select("slug", "name_en"))
    rate = F.coalesce("n_chars", F.lit(0)) / 50
    scores = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), rate.alias("replacement_rate"),
        F.when(clamp_rate(rate) >= 55, "high").otherwise("low").alias("risk_band"))
    told = known.select("id", F.col("roleSlug").alias("role_slug"), F.col("items")[0]["signalType"].alias("signal"))
    return regression.score_report(cases, scores).join(told, "id").select("id", "role_slug", "signal", "in_range", "band_ok")


@query("I24_attribution_from_files", f"""
with {GATED.replace('from fx_item)', "from (select * replace ('' as hint_text, case source_type when 'JOB_POSTING' then 'NEWS' else source_type end as source_type) from fx_item))")},
top as (select item_id, slug from cand where candidate_rank = 1),
e as (select item_id, case item_id % 3 when 0 then 'r1' when 1 then null else top.slug end as expected, top.slug as actual
      from fx_item left join top using (item_id))
select cast(item_id as varchar) as id, expected, actual, expected is not distinct from actual as ok from e""")
def i24_attribution_files(t: Inputs):
    from tidemark.session import new_state_dir

    kind = F.when(F.col("source_type") == "JOB_POSTING", "NEWS").otherwise(F.col("source_type"))
    path = new_state_dir(t.spark, "attribution-cases")
    t.fx_item.select(F.to_json(F.struct(
        F.col("item_id").cast("string").alias("id"), kind.alias("sourceType"), F.col("source_url").alias("sourceUrl"), "title", "summary",
        F.when(F.col("item_id") % 3 == 0, "r1").alias("expectedAssignedRoleSlug"))).alias("value")).write.text(path)
    cases = regression.read_cases(t.spark, path, regression.ATTRIBUTION_CASE, whole_files=False)
    items = cut_lineage(regression.attribution_items(cases))
    best = mt.select_candidates(items, lex(t), noise=FX_NOISE, workflow=FX_WORKFLOW).filter("candidate_rank = 1")
    # stands in for a classification: the best candidate
    classified = items.join(best.select("item_id", "slug"), "item_id", "left").select("item_id", F.struct(F.col("slug").alias("assigned_slug")).alias("c"))
    own = F.col("id").cast("long") % 3 == 2
    expected = cases.join(classified.select(F.col("item_id").alias("id"), F.col("c.assigned_slug").alias("_s")), "id").withColumn(
        "expectedAssignedRoleSlug", F.when(own, F.col("_s")).otherwise(F.col("expectedAssignedRoleSlug")))
    return regression.attribution_report(expected, classified).select("id", "expected", "actual", "ok")
