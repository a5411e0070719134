"""Items against the role lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import matching as mt
from tidemark.workload.registry import Inputs, query
from tidemark.workload.text import FX_NOISE, FX_WORKFLOW, STOP_SQL, _gate_sql

FOLD = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
LEX = """lexi as (select slug, phrase, min(position) as position, phrase as normal from (
    select slug, unnest(list_append(string_split(kw_text, ' '), name_en)) as phrase,
           unnest(range(len(string_split(kw_text, ' ')) + 1)) as position from fx_role
    union all select slug, concat(string_split(name_en, ' ')[2], ' ', string_split(name_en, ' ')[1]), 1000 from fx_role
    where slug like '%7') where length(phrase) > 0 group by slug, phrase)"""
# phrase hits are found per distinct phrase and joined to roles afterwards
SCORES = f"""{LEX},
tx as (select item_id, source_type, title || ' ' || summary as raw, {FOLD.format(c='title')} as ti, {FOLD.format(c='summary')} as su,
         {FOLD.format(c='hint_text')} as hi from fx_item),
ph as (select distinct normal from lexi),
hit as (select item_id, normal, contains(ti, normal) as a, contains(su, normal) as b, contains(hi, normal) as c
        from tx join ph on contains(ti, normal) or contains(su, normal) or contains(hi, normal)),
tok as (select distinct item_id, unnest(list_filter(string_split(ti || ' ' || su || ' ' || hi, ' '),
          lambda x: length(x) > 2 and x not in ({STOP_SQL}))) as w from tx),
rtok as (select distinct slug, unnest(list_filter(string_split(normal, ' '), lambda x: length(x) > 2)) as w from lexi),
pts as (select item_id, slug, case when a or b then 6.0::double else 0 end + case when a then 5.0::double else 0 end
          + case when b then 3.0::double else 0 end + case when c then 2.0::double else 0 end as s, 1 as m from hit join lexi using (normal)
        union all select item_id, slug, 1.5::double, 0 from tok join rtok using (w)),
sc as (select item_id, slug, sum(s) as score, least(6, sum(m)) as matched from pts group by item_id, slug)"""
GATED = f"""{SCORES},
g as (select *, case when source_type = 'JOB_POSTING' then 1.5 when wf then 0.5 else 1.0 end as score_floor from (
   select *, regexp_matches(raw, '{_gate_sql(FX_NOISE)}') as noisy, regexp_matches(raw, '{_gate_sql(FX_WORKFLOW)}') as wf from tx)
   where source_type = 'JOB_POSTING' or not noisy or wf),
cand as (select * from (select sc.*, row_number() over (partition by item_id order by score desc, slug) as candidate_rank
   from sc join g using (item_id) where score >= score_floor or matched > 0) where candidate_rank <= 20)"""


def lex(t: Inputs):
    words = F.split("kw_text", " ")
    parts = F.split("name_en", " ")
    aliases = t.fx_role.filter(F.endswith("slug", F.lit("7"))).select(
        "slug", F.concat_ws(" ", parts[1], parts[0]).alias("phrase"), F.lit(1000).alias("position"))
    return mt.lexicon(t.fx_role.select("slug", F.array_append(words, F.col("name_en")).alias("keywords")), aliases)


def candidates(t: Inputs):
    return mt.select_candidates(t.fx_item, lex(t), noise=FX_NOISE, workflow=FX_WORKFLOW)


@query("J5_phrase_match", f"with {SCORES} select item_id, slug, score, cast(matched as bigint) as matched from sc where matched > 0")
def j5(t: Inputs):
    return mt.role_scores(t.fx_item, lex(t)).select(
        "item_id", "slug", "score", F.col("matched").cast("long").alias("matched")
    )


@query("A11_keyword_score", f"""
with {SCORES} select item_id, count(*) as roles, sum(score) as total, max(score) as best from sc group by item_id""")
def a11(t: Inputs):
    return mt.score_totals(t.fx_item, lex(t))


@query("I3_role_candidates", f"""
with {GATED} select item_id, slug, score, cast(matched as bigint) as matched, candidate_rank from cand""")
def i3(t: Inputs):
    return candidates(t).select(
        "item_id", "slug", "score", F.col("matched").cast("long").alias("matched"),
        F.col("candidate_rank").cast("long").alias("candidate_rank"),
    )


@query("W10_candidate_top_20", f"""
with {GATED} select item_id, count(*) as n, string_agg(slug, ',' order by candidate_rank) as slugs from cand group by item_id""")
def w10(t: Inputs):
    # at most 20 per item
    listed = candidates(t).groupBy("item_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("candidate_rank", "slug"))).alias("c")
    )
    return listed.select("item_id", "n", F.array_join(F.transform("c", lambda x: x["slug"]), ",").alias("slugs"))


@query("A12_distinct_terms", """
select doc_id, (contains(x, 'ring')::int + contains(x, 'the')::int + contains(x, 'que')::int + contains(x, lang)::int)
  - case when lang in ('ring', 'the', 'que') then 1 else 0 end as n from (select doc_id, lang, lower(text) as x from documents)""")
def a12(t: Inputs):
    terms = F.array(F.lit("ring"), F.lit("the"), F.lit("que"), F.lit("the"), F.col("lang"))
    return t.documents.select("doc_id", mt.distinct_term_matches(F.lower("text"), terms).alias("n"))


FX_MAPPING = {
    "r-one": ("ring", "tion", "under the", "and"),
    "r-two": ("the and", "que", "les"),
    "r-three": ("der", "die", "und", "ring"),
}


@query("I2_mapping_decision", """
with lx as (select * from (values ('r-one', 'ring'), ('r-one', 'tion'), ('r-one', 'under the'), ('r-one', 'and'), ('r-two', 'the and'),
   ('r-two', 'que'), ('r-two', 'les'), ('r-three', 'der'), ('r-three', 'die'), ('r-three', 'und'), ('r-three', 'ring')) v(slug, p)),
tx as (select item_id, trim(regexp_replace(regexp_replace(lower(title || ' ' || summary), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) as x from fx_item),
c as (select item_id, slug, count(*) as score from tx join lx on contains(x, p) group by item_id, slug),
r as (select *, row_number() over (partition by item_id order by score desc, slug) as rn from c),
b as (select item_id, max(slug) filter (rn = 1) as top_slug, max(score) filter (rn = 1) as t, max(score) filter (rn = 2) as s from r group by item_id)
select i.item_id, case when t >= 3 and (s is null or t - s >= 2 or s <= 1) then 'accepted' when t is not null then 'ambiguous' else 'unmatched' end as status,
   case when t >= 3 and (s is null or t - s >= 2 or s <= 1) then top_slug end as primary_slug,
   case when t >= 3 then 'high' when t >= 2 then 'medium' when t >= 1 then 'low' end as confidence, coalesce(t, 0) as top_score
from fx_item i left join b using (item_id)""")
def i2(t: Inputs):
    return mt.keyword_decisions(t.fx_item, mt.mapping_lexicon(t.spark, FX_MAPPING))


@query("J14_assigned_in_candidates", f"""
with {GATED}, a as (select item_id, concat('r', item_id % 400) as assigned from fx_item)
select a.item_id, case when c.slug is not null then assigned end as assigned_slug from a left join cand c on a.item_id = c.item_id and a.assigned = c.slug""")
def j14(t: Inputs):
    from tidemark.plans.classify import with_candidates

    assigned = t.fx_item.withColumns(
        {"assigned": F.concat(F.lit("r"), F.col("item_id") % 400), "hints": F.split("hint_text", " ")}
    )
    listed = with_candidates(assigned, candidates(t), lex(t))
    inside = F.array_contains("candidate_slugs", F.col("assigned"))
    return listed.select("item_id", F.when(inside, F.col("assigned")).alias("assigned_slug"))


@query("J15_expected_vs_actual", """
select l.doc_id, cast(l.quality as varchar) as expected, case when d.n_chars > 1000 then '1' else '0' end as actual,
   cast(l.quality as varchar) = case when d.n_chars > 1000 then '1' else '0' end as ok
from labels l join documents d using (doc_id)""")
def j15(t: Inputs):
    expected = t.labels.select("doc_id", F.col("quality").cast("string").alias("value"))
    actual = t.documents.select("doc_id", F.when(F.col("n_chars") > 1000, "1").otherwise("0").alias("value"))
    return mt.compare_labels(expected, actual, "doc_id")


@query("A10_pass_counts", """
with c as (select l.quality = case when d.n_chars > 1000 then 1 else 0 end as ok from labels l join documents d using (doc_id))
select count(*) filter (ok) as passed, count(*) as total, bool_and(ok) as all_ok from c""")
def a10(t: Inputs):
    return mt.pass_counts(j15(t))
