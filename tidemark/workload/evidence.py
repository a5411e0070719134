"""Evidence weighting, pools and the per-role top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import policy, rates
from tidemark.operators import evidence as ev
from tidemark.operators.ranking import top_k, union_keep_first
from tidemark.workload.registry import Inputs, query

# pieces of the comparison SQL
KIND = """case when source_type in ('COMPANY_UPDATE', 'BLOG') then 'official'
          when source_type = 'JOB_POSTING' then 'jobs' else 'media' end"""
SIGNAL = """case
    when upper(trim(json_extract_string(raw_json, '$.signalType'))) in ('ADOPTION', 'ADOPTION_CASE',
         'CAPABILITY_UPDATE', 'WORKFLOW_RESTRUCTURE') then 'ADOPTION'
    when upper(trim(json_extract_string(raw_json, '$.signalType'))) = 'HIRING_SHIFT' then 'HIRING_SHIFT'
    when upper(trim(json_extract_string(raw_json, '$.signalType'))) in ('TOOLING', 'ECOSYSTEM_CONTEXT')
         then 'TOOLING'
    when upper(trim(json_extract_string(raw_json, '$.value'))) = 'HIRING_SHIFT' then 'HIRING_SHIFT'
    when source_type = 'JOB_POSTING' then 'HIRING_SHIFT'
    when source_type = 'COMPANY_UPDATE' then 'ADOPTION' else 'TOOLING' end"""
VETO = """coalesce(json_type(raw_json, '$.strategyCanAffectReplacementRate') = 'BOOLEAN'
    and json_extract_string(raw_json, '$.strategyCanAffectReplacementRate') = 'false', false)"""
WEIGHTED = f"""
    typed as (select *, {KIND} as kind, {SIGNAL} as sig, {VETO} as veto,
                     starts_with(source_catalog_id, 'discovery-') as disc from fx_evidence),
    weighed as (select *, floor(signal_weight * case when disc then 0.75::double else 1::double end
        * case kind when 'official' then 1::double when 'jobs' then 0.45::double else 0.65::double end
        * case sig when 'ADOPTION' then 1::double when 'HIRING_SHIFT' then 0.65::double else 0.35::double end
        * case relevance when 'HIGH' then 1::double when 'MEDIUM' then 0.8::double else 0.45::double end
        * case impact when 'INCREASE' then 1::double when 'DECREASE' then 0.7::double else 0.55::double end
        * 100 + 0.5) / 100 as adjusted_weight from typed),
    kept as (select * from weighed where not veto
        and not (kind = 'media' and sig = 'TOOLING')
        and not (kind = 'jobs' and sig <> 'HIRING_SHIFT')
        and not (kind = 'jobs' and signal_weight < 0.3)
        and not (kind = 'media' and relevance = 'MEDIUM' and signal_weight < 0.6)
        and not (relevance = 'LOW' and kind <> 'official')
        and not (impact = 'MAINTAIN' and sig = 'TOOLING')
        and adjusted_weight >= case when kind = 'media' and disc then 0.2 when kind = 'official' then 0.25
            when kind = 'jobs' then 0.28 when relevance = 'MEDIUM' then 0.3 else 0.4 end)"""


@query("I7_evidence_top8", f"""
with {WEIGHTED},
r as (select *, row_number() over (partition by role_slug order by adjusted_weight desc,
        cast(published_at as date) desc, title, item_id) as evidence_rank from kept)
select role_slug, evidence_rank, item_id, kind as source_kind, sig as policy_signal_type,
       adjusted_weight, cast(cast(published_at as date) as varchar) as published_day
from r where evidence_rank <= 8""")
def i7(t: Inputs):
    return ev.scoring_evidence(t.fx_evidence).select(
        "role_slug", F.col("evidence_rank").cast("long").alias("evidence_rank"), "item_id", "source_kind",
        "policy_signal_type", "adjusted_weight", F.col("published_day").cast("string").alias("published_day"),
    )


@query("W9_scoring_order", f"""
with {WEIGHTED},
r as (select *, row_number() over (partition by role_slug order by adjusted_weight desc,
        cast(published_at as date) desc, title, item_id) as rn from kept)
select role_slug, count(*) as n, max(adjusted_weight) as heaviest, min(adjusted_weight) as lightest
from r where rn <= 8 group by role_slug""")
def w9(t: Inputs):
    return ev.scoring_evidence(t.fx_evidence).groupBy("role_slug").agg(
        F.count("*").alias("n"), F.max("adjusted_weight").alias("heaviest"),
        F.min("adjusted_weight").alias("lightest"),
    )


def _pool_sql(recent: int, backstop: int) -> str:
    return f"""
with e as (select role_slug, item_id, published_at, not starts_with(source_catalog_id, 'discovery-') as prim from fx_evidence),
r as (select role_slug, item_id, prim, row_number() over (partition by role_slug order by published_at desc, item_id) as rn_all,
        row_number() over (partition by role_slug, prim order by published_at desc, item_id) as rn_lane from e)
select role_slug, item_id from r where rn_all <= {recent} or (prim and rn_lane <= {backstop})"""


@query("W8_evidence_pool", _pool_sql(24, 64))
def w8(t: Inputs):
    return ev.evidence_pool(t.fx_evidence).select("role_slug", "item_id")


@query("W8_evidence_pool_narrow", _pool_sql(8, 12))
def w8_narrow(t: Inputs):
    return ev.evidence_pool(t.fx_evidence, recent=8, backstop=12).select("role_slug", "item_id")


@query("T1_union_keep_first", """
with a as (select item_id, role_slug, 'recent' as lane, row_number() over (partition by role_slug
             order by published_at desc, item_id) as rn from fx_evidence),
b as (select item_id, role_slug, 'backstop' as lane, row_number() over (partition by role_slug
             order by published_at desc, item_id) as rn from fx_evidence
      where not starts_with(source_catalog_id, 'discovery-'))
select item_id, role_slug, lane from a where rn <= 8
union all
select item_id, role_slug, lane from b where rn <= 12
  and item_id not in (select item_id from a where rn <= 8)""")
def t1(t: Inputs):
    newest = [F.col("published_at").desc(), F.col("item_id").asc()]
    e = t.fx_evidence.select("item_id", "role_slug", "source_catalog_id", "published_at")
    recent = top_k(e, ["role_slug"], newest, 8).withColumn("lane", F.lit("recent"))
    primary = e.filter(~policy.is_discovery(F.col("source_catalog_id")))
    backstop = top_k(primary, ["role_slug"], newest, 12).withColumn("lane", F.lit("backstop"))
    return union_keep_first(recent, backstop, ["item_id"]).select("item_id", "role_slug", "lane")


@query("A1_coverage_counts", """
with pub as (select *, regexp_replace(lower(regexp_extract(source_url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') as h
             from fx_evidence where decision_status = 'ACCEPTED'),
s as (select item_id, decision_slug as slug from pub where h <> 'example.com' and decision_slug is not null
      union
      select item_id, role_slug from pub where h <> 'example.com'),
c as (select role_slug as slug from fx_hit where rank % 2 = 0)
select slug, count(*) as coverage from (select slug from s union all select slug from c) group by slug""")
def a1(t: Inputs):
    hits = t.fx_hit.select(
        "role_slug", F.col("url").alias("source_url"), (F.col("rank") % 2 == 0).alias("timeline_eligible")
    )
    return ev.coverage_counts(t.fx_evidence, hits)


@query("P17_weight_clamp", """
select item_id, least(1.0, greatest(0.0, floor((signal_weight * 1.7 - 0.4) * 100 + 0.5) / 100)) as w
from fx_evidence""")
def p17(t: Inputs):
    raw = F.col("signal_weight") * F.lit(1.7) - F.lit(0.4)
    return t.fx_evidence.select("item_id", rates.clamp_weight(raw).alias("w"))


@query("P18_enum_remaps", f"""
select item_id, {KIND} as kind, {SIGNAL} as sig,
       case when lower(impact) = 'neutral' then 'MAINTAIN' else upper(lower(impact)) end as impact_direction,
       case when lower(relevance) = 'none' then 'LOW' else upper(lower(relevance)) end as stored_relevance,
       case lower(decision_status) when 'accepted' then 'ACCEPTED' when 'ambiguous' then 'AMBIGUOUS'
            else 'UNMATCHED' end as status,
       case when lower(relevance) in ('high', 'medium') then lower(relevance) else 'low' end as confidence
from fx_evidence""")
def p18(t: Inputs):
    rel = F.lower("relevance")
    return policy.with_raw_fields(t.fx_evidence).select(
        "item_id",
        policy.source_kind(F.col("source_type")).alias("kind"),
        policy.policy_signal_type(F.col("source_type")).alias("sig"),
        policy.impact_direction(F.lower("impact")).alias("impact_direction"),
        policy.stored_relevance(rel).alias("stored_relevance"),
        policy.decision_status(F.lower("decision_status")).alias("status"),
        policy.confidence_of_relevance(rel).alias("confidence"),
    )


@query("P33_policy_signal_type", f"select item_id, {SIGNAL} as sig from fx_evidence")
def p33(t: Inputs):
    return policy.with_raw_fields(t.fx_evidence).select(
        "item_id", policy.policy_signal_type(F.col("source_type")).alias("sig")
    )


@query("P34_strategy_veto", """
select item_id, case when json_type(raw_json, '$.strategyCanAffectReplacementRate') = 'BOOLEAN'
       then cast(json_extract(raw_json, '$.strategyCanAffectReplacementRate') as boolean) end as can_affect
from fx_evidence""")
def p34(t: Inputs):
    return policy.with_raw_fields(t.fx_evidence).select("item_id", F.col("raw_veto").alias("can_affect"))


# classification fields derived from the evidence view, the same in both engines
CLASSIFIED = """
    select item_id, source_type, source_catalog_id, role_slug,
           case when source_type in ('COMPANY_UPDATE', 'BLOG') then 'official'
                when source_type = 'JOB_POSTING' then 'jobs' else 'media' end as source_class,
           case when impact = 'MAINTAIN' and relevance = 'LOW' then 'other'
                when source_type = 'NEWS' then 'media' else 'official' end as kind,
           case impact when 'INCREASE' then case when source_type = 'JOB_POSTING' then 'hiring_shift'
                else 'adoption_case' end when 'DECREASE' then 'workflow_restructure'
                else 'ecosystem_context' end as signal,
           lower(relevance) as relevance,
           case when signal_weight >= 0.7 then 'primary' when signal_weight >= 0.3 then 'secondary'
                else 'supporting' end as weight_label
    from {src}"""
STRATEGY = """case when kind = 'other' or signal = 'ecosystem_context' then 'broad_ecosystem_context'
    when source_type = 'JOB_POSTING' or source_class = 'jobs' then 'jobs_hiring_shift'
    when source_class = 'official' then 'official_capability_update'
    when source_class = 'media' then 'media_adoption_case' else 'broad_ecosystem_context' end"""
BASE = """floor(case source_class when 'official' then 1.0::double when 'media' then 0.8::double else 0.6::double end
    * case weight_label when 'primary' then 1.0::double when 'secondary' then 0.7::double else 0.45::double end
    * case relevance when 'high' then 1.0::double when 'medium' then 0.8::double when 'low' then 0.55::double
           else 0::double end * 100 + 0.5) / 100"""


def classified(t: Inputs):
    return t.spark.sql(CLASSIFIED, src=t.fx_evidence)


@query("P26_item_strategy", f"""
with c as ({CLASSIFIED.format(src='fx_evidence')}), s as (select *, {STRATEGY} as strategy_id from c)
select item_id, strategy_id,
       case strategy_id when 'jobs_hiring_shift' then 'hiring_shift' when 'official_capability_update'
            then 'capability_update' when 'media_adoption_case' then 'adoption_case'
            else 'ecosystem_context' end as default_signal_type,
       strategy_id <> 'broad_ecosystem_context' as can_affect_rate,
       case when strategy_id in ('jobs_hiring_shift', 'official_capability_update') then 'balanced'
            else 'conservative' end as attribution_bias
from s""")
def p26(t: Inputs):
    s = policy.item_strategy(F.col("source_class"), F.col("source_type"), F.col("kind"), F.col("signal"))
    return classified(t).select("item_id", s.alias("s")).select("item_id", "s.*")


def with_policy(c):
    s = policy.item_strategy(F.col("source_class"), F.col("source_type"), F.col("kind"), F.col("signal"))
    return c.withColumn("s", s).withColumn(
        "p",
        policy.signal_policy(
            F.col("source_class"), F.col("source_catalog_id"), F.col("role_slug"),
            F.col("s.default_signal_type"), F.col("s.can_affect_rate"), F.col("relevance"),
            F.col("weight_label"), F.col("kind"), F.col("signal"),
        ),
    )


@query("P27_signal_policy", f"""
with c as ({CLASSIFIED.format(src='fx_evidence')}),
b as (select *, {STRATEGY} as strategy_id, {BASE} as base from c),
w as (select *, floor(base * case when starts_with(source_catalog_id, 'discovery-') then 0.72::double
                             else 1::double end * 100 + 0.5) / 100 as signal_weight from b)
select item_id,
       case signal when 'hiring_shift' then 'HIRING_SHIFT' when 'ecosystem_context' then 'TOOLING'
            else 'ADOPTION' end as signal_type,
       case when signal_weight >= 0.85 then 'HIGH' when signal_weight >= 0.5 then 'MEDIUM' else 'LOW' end
            as signal_strength,
       signal_weight,
       kind <> 'other' and signal <> 'ecosystem_context' and case source_class
            when 'jobs' then signal = 'hiring_shift'
            when 'official' then relevance <> 'low' and base >= 0.5
            else relevance = 'high' and base >= 0.5 end as keep_signal
from w""")
def p27(t: Inputs):
    return with_policy(classified(t)).select("item_id", "p.*")


@query("P28_signal_strength", f"""
with c as ({CLASSIFIED.format(src='fx_evidence')}), b as (select *, {BASE} as base from c)
select item_id, case when kind = 'other' then
         case when source_type = 'COMPANY_UPDATE' and signal = 'adoption_case' then 'HIGH'
              when source_type = 'JOB_POSTING' then 'MEDIUM' else 'LOW' end
       when base >= 0.85 then 'HIGH' when base >= 0.5 then 'MEDIUM' else 'LOW' end as strength
from b""")
def p28(t: Inputs):
    c = with_policy(classified(t).withColumn("source_catalog_id", F.lit(None).cast("string")))
    legacy_type = F.when(F.col("signal") == "adoption_case", "ADOPTION").otherwise("TOOLING")
    return c.select(
        "item_id",
        F.when(F.col("kind") == "other", policy.legacy_strength(F.col("source_type"), legacy_type))
        .otherwise(F.col("p.signal_strength")).alias("strength"),
    )


@query("J16_role_lookup", """
select e.item_id, s.replacement_rate as rate, s.slug as known_slug
from fx_evidence e left join fx_state s on e.decision_slug = s.slug""")
def j16(t: Inputs):
    known = t.fx_state.select(F.col("slug").alias("known_slug"), F.col("replacement_rate").alias("rate"))
    e = t.fx_evidence.select("item_id", "decision_slug")
    return e.join(known, e.decision_slug == known.known_slug, "left").select("item_id", "rate", "known_slug")


@query("T5_affected_roles", """
select distinct e.decision_slug as slug from fx_evidence e join fx_state s on e.decision_slug = s.slug
where e.decision_status = 'ACCEPTED'""")
def t5(t: Inputs):
    accepted = t.fx_evidence.filter(F.col("decision_status") == "ACCEPTED")
    slugs = accepted.select(F.col("decision_slug").alias("slug")).distinct()
    return slugs.join(t.fx_state.select("slug"), "slug", "left_semi")
