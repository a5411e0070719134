"""Dictionary, state, rankings, topics, related roles and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import presentation
from tidemark.operators import catalogue as cat
from tidemark.operators.evidence import coverage_counts
from tidemark.operators.ranking import global_positions
from tidemark.session import cut_lineage
from tidemark.sources.dictionary import role_dictionary, source_codes
from tidemark.workload.registry import Inputs, query


def roles(t: Inputs):
    return t.fx_role.withColumn("keywords", F.split("kw_text", " "))


# profile terms with hits in the fixture words come from these lists
def _any(text: str, terms) -> str:
    return "(" + " or ".join(f"contains({text}, '{x}')" for x in terms) + ")"


def profile_sql(source: str, count: str, text: str = "lower(concat_ws(' ', slug, name_en, kw_text))") -> str:
    rep, soft = _any("tx", rules.REPEATED_TEXT_TERMS), _any("tx", rules.SOFTWARE_TERMS)
    phys, judg = _any("tx", rules.PHYSICAL_TERMS), _any("tx", rules.JUDGMENT_TERMS)
    return f"""(select *, case when i_rate >= 80 then 'SEVERE' when i_rate >= 55 then 'HIGH'
        when i_rate >= 30 then 'MEDIUM' else 'LOW' end as i_level from (
      select *, cast(greatest(8, least(88, 34 + case when rep then 18 else 0 end + case when soft then 22 else 0 end
        - case when phys then 16 else 0 end - case when judg then 8 else 0 end
        + case when cnt > 0 then least(10, cnt * 2) else 0 end)) as int) as i_rate from (
      select *, {rep} as rep, {soft} as soft, {phys} as phys, {judg} as judg from (
      select *, {text} as tx, {count} as cnt from {source}))))"""


def summary_sql(cnt: str, loc: str) -> str:
    p = rules.PROFILE_SUMMARY
    if loc == "en":
        a, b, c = p["tracked_en"]
        return (f"case when {cnt} > 0 then concat('{a}', {cnt}, '{b}', case when {cnt} = 1 then '' else 's' end, "
                f"'{c}') else '{p['none_en']}' end")
    a, b = p["tracked_zh"]
    return f"case when {cnt} > 0 then concat('{a}', {cnt}, '{b}') else '{p['none_zh']}' end"


# words which do occur in the fixture names, so that each term group is met
PROFILE_ROLES = """(select slug, name_en, name_zh, industry_code, is_active,
    concat(kw_text, case when name_en like '%ring' then ' software' when name_en like '%bolt' then ' field repair'
      when name_en like '%plate' then ' sales managers' when name_en like '%rod' then ' data entry' else '' end) as kw_text
    from fx_role)"""


def profile_roles(t: Inputs):
    name = F.col("name_en")
    extra = (
        F.when(F.endswith(name, F.lit("ring")), " software").when(F.endswith(name, F.lit("bolt")), " field repair")
        .when(F.endswith(name, F.lit("plate")), " sales managers")
        .when(F.endswith(name, F.lit("rod")), " data entry").otherwise("")
    )
    text = F.concat("kw_text", extra)
    return t.fx_role.withColumn("kw_text", text).withColumn("keywords", F.split("kw_text", " "))


@query("P29_role_profile", f"""
select slug, i_rate as replacement_rate, i_level as risk_level,
   case when rep then 4 else 2 end as repetition_score, case when soft then 5 else 3 end as transformation_score,
   case when soft or rep then 4 else 2 end as workflow_automation_score,
   case when judg then 4 else 2 end as interpersonal_score, case when phys then 5 else 1 end as physicality_score,
   {summary_sql('cnt', 'en')} as summary_en, {summary_sql('cnt', 'zh')} as summary_zh,
   case when soft then '{rules.REASON_DETAILS['software'][0]}' when rep then '{rules.REASON_DETAILS['repeated'][0]}'
        else '{rules.REASON_DETAILS['neither'][0]}' end as first_detail,
   case when phys then '{rules.REASON_DETAILS['physical'][1]}' when judg then '{rules.REASON_DETAILS['judgment'][1]}'
        else '{rules.REASON_DETAILS['exposed'][1]}' end as second_detail_zh,
   case when cnt > 0 then 2 else 3 end as reasons
from {profile_sql(PROFILE_ROLES, "length(name_en) % 7")}""")
def p29(t: Inputs):
    p = cat.with_profile(profile_roles(t), F.length("name_en") % 7)
    return p.select(
        "slug", "replacement_rate", "risk_level", "repetition_score", "transformation_score",
        "workflow_automation_score", "interpersonal_score", "physicality_score", "summary_en", "summary_zh",
        F.col("reasons")[0]["detail_en"].alias("first_detail"),
        F.col("reasons")[1]["detail_zh"].alias("second_detail_zh"), F.size("reasons").alias("reasons"),
    )


J1_SQL = f"""(select r.slug, r.kw_text, r.is_active, coalesce(s.name_en, r.name_en) as name_en,
    coalesce(s.name_zh, r.name_zh) as name_zh, coalesce(s.replacement_rate, r.i_rate) as replacement_rate,
    coalesce(s.risk_level, r.i_level) as risk_level, coalesce(s.rating_status, 'RATED') as rating_status,
    coalesce(s.risk_summary_en, {summary_sql('0', 'en')}) as risk_summary_en,
    coalesce(s.risk_summary_zh, {summary_sql('0', 'zh')}) as risk_summary_zh
    from {profile_sql(PROFILE_ROLES, '0')} r left join fx_state s on r.slug = s.slug)"""


@query("J1_dictionary_with_state", f"""
select slug, name_en, name_zh, replacement_rate, risk_level, rating_status, risk_summary_en, risk_summary_zh
from {J1_SQL} where is_active""")
def j1(t: Inputs):
    j = cat.with_stored_state(profile_roles(t).filter("is_active"), t.fx_state)
    return j.select(
        "slug", "name_en", "name_zh", "replacement_rate", "risk_level", "rating_status", "risk_summary_en",
        "risk_summary_zh",
    )


COVERAGE_SQL = """cov as (with pub as (select *, regexp_replace(lower(regexp_extract(source_url,
      '^https?://([^/:?#]+)', 1)), '^www\\.', '') as h from fx_evidence where decision_status = 'ACCEPTED'),
    s as (select item_id, decision_slug as slug from pub where h <> 'example.com' and decision_slug is not null
      union select item_id, role_slug from pub where h <> 'example.com')
    select slug, count(*) as coverage from (select slug from s union all select role_slug from fx_hit where rank % 2 = 0)
    group by slug)"""


def _placeholder(col: str) -> str:
    return "(" + " or ".join(f"contains({col}, '{x}')" for x in rules.PLACEHOLDER_SUMMARIES) + ")"


def _resolved(col: str, cnt: str, loc: str) -> str:
    t = rules.TIMELINE_SUMMARY[loc]
    text = (f"concat('{t[0]}', {cnt}, '{t[1]}', case when {cnt} = 1 then '' else 's' end, '{t[2]}')" if loc == "en"
            else f"concat('{t[0]}', {cnt}, '{t[1]}')")
    return f"case when {cnt} > 0 and {col} is not null and {_placeholder(col)} then {text} else {col} end"


HOME_SQL = f"""{COVERAGE_SQL},
st as (select slug, name_en, name_zh, risk_level, rating_status, coalesce(coverage, 0) as coverage, replacement_rate,
         {_resolved('risk_summary_en', 'coalesce(coverage, 0)', 'en')} as risk_summary_en,
         {_resolved('risk_summary_zh', 'coalesce(coverage, 0)', 'zh')} as risk_summary_zh
       from fx_state left join cov using (slug)),
di as (select slug, name_en, name_zh, i_level, 'RATED', cnt, i_rate, {summary_sql('cnt', 'en')}, {summary_sql('cnt', 'zh')}
       from {profile_sql(f"(select r.*, coalesce(coverage, 0) as cv from {PROFILE_ROLES} r left join cov using (slug) where is_active)", "cv")}),
home as (select * from st union all select * from di where slug not in (select slug from st)),
sev as (select *, case risk_level when 'SEVERE' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end as sv,
          case when rating_status = 'RATED' then 0 else 1 end as un,
          case when slug in ({', '.join(f"'{s}'" for s in rules.PRIORITY_SLUGS)}) then 0 else 1 end as pr,
          case when name_zh <> name_en then 0 else 1 end as tr from home),
pos as (select *, row_number() over (order by coverage desc, un, case when un = 1 then pr else 0 end,
          case when un = 1 then tr else 0 end, sv, name_en, slug) as position from sev)"""


def home(t: Inputs):
    hits = t.fx_hit.select(
        "role_slug", F.col("url").alias("source_url"), (F.col("rank") % 2 == 0).alias("timeline_eligible")
    )
    return cat.home_rows(profile_roles(t), t.fx_state, coverage_counts(t.fx_evidence, hits))


@query("J2_override_union", f"""
with {HOME_SQL}
select slug, name_en, name_zh, risk_level, rating_status, cast(coverage as bigint) as coverage, replacement_rate,
       risk_summary_en, risk_summary_zh from home""")
def j2(t: Inputs):
    return home(t)


@query("W2_home_order", f"""
with {HOME_SQL}
select position, slug, cast(coverage as bigint) as coverage from pos where position <= 760""")
def w2(t: Inputs):
    listed = cat.home_list(home(t))
    return cat.numbered(listed, cat.home_order()).select(
        F.col("position").cast("long").alias("position"), "slug", "coverage"
    )


@query("W3_home_ranking", f"""
with {HOME_SQL},
r as (select *, row_number() over (order by replacement_rate desc, name_en, slug) as rk from pos
      where position <= 760 and replacement_rate is not null)
select rk, slug, name_en, name_zh, replacement_rate from r where rk <= 10""")
def w3(t: Inputs):
    order = [F.col("replacement_rate").desc(), F.col("name_en"), F.col("slug")]
    return cat.numbered(cat.home_ranking(home(t)), order, "rk").select(
        F.col("rk").cast("long").alias("rk"), "slug", "name_en", "name_zh", "replacement_rate"
    )


@query("W15_least_covered", f"""
with {HOME_SQL},
c as (select slug, coverage from pos where position <= 760 order by coverage, name_en, slug limit 25)
select distinct slug, cast(coverage as bigint) as coverage from c where slug not in ('', 'ai', 'model', 'models')""")
def w15(t: Inputs):
    return cat.least_covered(home(t), 25)


@query("W22_page_slice", f"""
with {HOME_SQL} select slug, position from pos where position <= 48""")
def w22(t: Inputs):
    rows = cat.page(home(t), cat.home_order(), 24, 2)
    return cat.numbered(rows, cat.home_order()).select("slug", F.col("position").cast("long").alias("position"))


@query("A14_visible_rows", f"""
with {HOME_SQL}
select count(*) as visible_en, count(*) filter (length(trim(name_zh)) > 0 and name_zh <> name_en) as visible_zh
from pos where position <= 760""")
def a14(t: Inputs):
    return cat.home_list(home(t)).agg(
        F.count("*").alias("visible_en"),
        F.count_if(presentation.has_chinese_name(F.col("name_en"), F.col("name_zh"))).alias("visible_zh"),
    )


PRESENT_SQL = f"""
   case when rating_status = 'INSUFFICIENT_SIGNAL' then null else case risk_level when 'LOW' then 18 when 'MEDIUM' then 43
        when 'HIGH' then 68 else 86 end end as percentage,
   case when rating_status = 'RATED' and replacement_rate is not null then concat(replacement_rate, '%')
        when rating_status = 'INSUFFICIENT_SIGNAL' then '{{pending}}'
        else concat(case risk_level when 'LOW' then 18 when 'MEDIUM' then 43 when 'HIGH' then 68 else 86 end, '%') end as label,
   coalesce({{summary}}, case when rating_status = 'INSUFFICIENT_SIGNAL' then '{{pending_summary}}' else
        case risk_level when 'LOW' then '{{LOW}}' when 'MEDIUM' then '{{MEDIUM}}' when 'HIGH' then '{{HIGH}}' else '{{SEVERE}}' end end) as summary,
   case when rating_status = 'INSUFFICIENT_SIGNAL' then 'risk-insufficient' else concat('risk-', lower(risk_level)) end as class_name"""


def present_sql(loc: str, summary: str) -> str:
    return PRESENT_SQL.format(pending=rules.PENDING_LABEL[loc], pending_summary=rules.PENDING_SUMMARY[loc],
                              summary=summary, **rules.BAND_SUMMARY[loc])


@query("P19_presentation", f"""
select slug, 'en' as locale, {present_sql('en', 'risk_summary_en')} from fx_state
union all
select slug, 'zh' as locale, {present_sql('zh', 'risk_summary_zh')} from fx_state""")
def p19(t: Inputs):
    def of(loc: str):
        p = presentation.present(
            F.col("risk_level"), F.col("rating_status"), loc, F.col("replacement_rate"),
            F.col(f"risk_summary_{loc}"),
        )
        return t.fx_state.select("slug", F.lit(loc).alias("locale"), *[c.alias(n) for n, c in p.items()])

    return of("en").unionByName(of("zh"))


@query("P20_locale_filter", """
select slug, name_zh as name from fx_role where length(trim(name_zh)) > 0 and name_zh <> name_en""")
def p20(t: Inputs):
    en, zh = F.col("name_en"), F.col("name_zh")
    return t.fx_role.filter(presentation.has_chinese_name(en, zh)).select(
        "slug", presentation.local_name(en, zh, "zh").alias("name")
    )


@query("P21_resolved_summary", f"""
select slug, {_resolved('risk_summary_en', 'n', 'en')} as summary_en, {_resolved('risk_summary_zh', 'n', 'zh')} as summary_zh
from (select *, s_repetition as n from fx_state)""")
def p21(t: Inputs):
    n = F.col("s_repetition")
    return t.fx_state.select(
        "slug", presentation.resolved_summary(F.col("risk_summary_en"), n, "en").alias("summary_en"),
        presentation.resolved_summary(F.col("risk_summary_zh"), n, "zh").alias("summary_zh"),
    )


@query("I19_home_view", f"""
with {HOME_SQL},
g as (select slug, row_number() over (order by replacement_rate desc, name_en, slug) as rk, name_en, name_zh from pos
      where position <= 760 and replacement_rate is not null),
sg as (select slug, name_en, name_zh, row_number() over (order by case when slug in
         ({', '.join(f"'{s}'" for s in rules.PRIORITY_SLUGS)}) then 0 else 1 end,
         case when name_zh <> name_en then 0 else 1 end, name_en, slug) as rk from {PROFILE_ROLES} where is_active)
select 'rows' as part, slug, name_zh as name, label from (select *, {present_sql('zh', 'risk_summary_zh')} from pos where position <= 760)
  where length(trim(name_zh)) > 0 and name_zh <> name_en
union all select 'ranking', slug, name_zh, null from g where rk <= 10 and length(trim(name_zh)) > 0 and name_zh <> name_en
union all select 'suggestions', slug, name_zh, null from sg where rk <= 760 and length(trim(name_zh)) > 0 and name_zh <> name_en""")
def i19(t: Inputs):
    from tidemark.plans.home import home_view

    view = home_view(profile_roles(t), home(t), "zh")
    none = F.lit(None).cast("string")
    return (
        view.rows.select(F.lit("rows").alias("part"), "slug", "name", "label")
        .unionByName(view.ranking.select(F.lit("ranking").alias("part"), "slug", "name", none.alias("label")))
        .unionByName(view.suggestions.select(F.lit("suggestions").alias("part"), "slug", "name", none.alias("label")))
    )


@query("W1_display_order", """
select slug, row_number() over (order by case when name_zh <> name_en then 0 else 1 end,
   case risk_level when 'SEVERE' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, name_en, slug) as position
from fx_state""")
def w1(t: Inputs):
    return global_positions(t.fx_state, cat.display_order()).select("slug", "position")


@query("W21_suggestions", """
select slug, name_en, name_zh from fx_role where is_active
order by case when name_zh <> name_en then 0 else 1 end, name_en, slug limit 760""")
def w21(t: Inputs):
    return cat.suggestions(t.fx_role, 760)


@query("W18_index_list", """
select slug, updated_at, row_number() over (order by updated_at desc, slug) as position from fx_role where is_active""")
def w18(t: Inputs):
    order = [F.col("updated_at").desc(), F.col("slug").asc()]
    listed = t.fx_role.filter("is_active")
    return global_positions(listed, order).select("slug", "updated_at", "position")


TOPICS_FX = {
    "high": (None, 55, 20),
    "rings": (("ring", "economies"), None, 24),
    "plates": (("hot plates", "promo"), 40, 15),
}


def terms_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


J4_TERMS = ("ring", "economies", "economy")


@query("J4_topic_members", f"""
select slug from fx_role where list_has_any(list_concat(string_split(kw_text, ' '),
   list_transform(string_split(kw_text, ' '), lambda x: case when length(x) > 4 and x like '%s' then x[:-2] else x end)), ['ring', 'economies', 'economy'])""")
def j4(t: Inputs):
    return cat.topic_members(roles(t), ("ring", "economies")).select("slug")


TOPIC_SQL = f"""
j as {J1_SQL},
m as (select 'high' as topic, 20 as lim, * from j where is_active and replacement_rate >= 55
 union all select 'rings', 24, * from j where is_active and list_has_any(string_split(kw_text, ' '), ['ring', 'economies', 'economy'])
 union all select 'plates', 15, * from j where is_active and replacement_rate >= 40 and list_has_any(
    string_split(kw_text, ' '), ['hot plates', 'hot', 'plates', 'plate', 'promo'])),
r as (select *, row_number() over (partition by topic order by replacement_rate desc nulls last, name_en, slug) as topic_rank from m)"""


def topic_input(t: Inputs):
    return cat.with_stored_state(profile_roles(t).filter("is_active"), t.fx_state)


@query("I18_topic_pages", f"""
with {TOPIC_SQL} select topic, topic_rank, slug, name_en, replacement_rate from r where topic_rank <= lim""")
def i18(t: Inputs):
    return cat.topic_rows(topic_input(t), TOPICS_FX).select(
        "topic", F.col("topic_rank").cast("long").alias("topic_rank"), "slug", "name_en", "replacement_rate"
    )


FEATURED_FX = ("plates", "high")


@query("I18_featured_topics", f"""
with {TOPIC_SQL} select case topic when 'plates' then 1 else 2 end as featured_rank, topic, topic_rank, slug
from r where topic_rank <= lim and topic in ('plates', 'high')""")
def i18_featured(t: Inputs):
    return cat.featured_topics(topic_input(t), FEATURED_FX, TOPICS_FX).select(
        F.col("featured_rank").cast("long").alias("featured_rank"), "topic", F.col("topic_rank").cast("long").alias("topic_rank"), "slug"
    )


@query("W4_topic_order", f"""
with {TOPIC_SQL} select slug, topic_rank from r where topic = 'rings' and topic_rank <= 24""")
def w4(t: Inputs):
    one = {"rings": TOPICS_FX["rings"]}
    return cat.topic_rows(topic_input(t), one).select("slug", F.col("topic_rank").cast("long").alias("topic_rank"))


def _related_sql(k: int) -> str:
    return f"""
with d as (select *, string_split(kw_text, ' ') as kw from fx_role),
p as (select a.slug as base_slug, b.slug as related_slug, b.name_en, case when b.name_zh <> b.name_en then 0 else 1 end as un,
        len(list_filter(a.kw, lambda x: list_contains(b.kw, x))) as overlap
      from d a join d b on a.industry_code = b.industry_code and a.slug <> b.slug and b.is_active),
r as (select *, row_number() over (partition by base_slug order by overlap desc, un, name_en, related_slug) as related_rank from p)
select base_slug, related_rank, related_slug, cast(overlap as bigint) as overlap from r where related_rank <= {k}"""


def _related(t: Inputs, k: int):
    return cat.related_roles(roles(t), k).select(
        "base_slug", F.col("related_rank").cast("long").alias("related_rank"), "related_slug",
        F.col("overlap").cast("long").alias("overlap"),
    )


@query("J3_related_overlap", _related_sql(4))
def j3(t: Inputs):
    return _related(t, 4)


@query("W5_related_top_k", _related_sql(6))
def w5(t: Inputs):
    return _related(t, 6)


def _search_sql(q: str, words) -> str:
    sub = "%".join(q.replace(" ", ""))
    every = " and ".join(f"contains(x, '{w}')" for w in words)

    def of(c: str) -> str:
        x = f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
        return f"""(select case when length(x) = 0 then -1 when x = '{q}' then 1000 when instr(x, '{q}') = 1 then 900
            when instr(x, '{q}') > 0 then 801 - instr(x, '{q}') when {every} then 650 - length(x)
            when replace(x, ' ', '') like '%{sub}%' then 500 - length(x) else -1 end from (select {x} as x))"""

    return f"""select '{q}' as q, slug, cast(greatest({of('name_en')}, {of('name_zh')}, {of('slug')}) as bigint) as score, name_en from fx_role"""


SEARCHES = ("small ring", "ring small", "bolt", "rdwdgt", "r12", "hot plate zh")


@query("W20_name_search", "with s as (" + " union all ".join(_search_sql(q, q.split()) for q in SEARCHES) + """),
r as (select *, row_number() over (partition by q order by score desc, name_en, slug) as rn from s where score >= 0)
select q, slug, score from r where rn <= 8""")
def w20(t: Inputs):
    from tidemark.functions.text import fold_unicode

    folded = t.fx_role.select("slug", "name_en", *[fold_unicode(F.col(c)).alias(f"f_{c}") for c in ("name_en", "name_zh", "slug")])
    return cat.search_names(folded, SEARCHES, ("f_name_en", "f_name_zh", "f_slug"), "name_en").select(
        F.col("query").alias("q"), "slug", F.col("score").cast("long").alias("score"))


@query("T6_distinct_ignoring_case", """
with v as (select slug, unnest([name_en, upper(name_en), '  ' || name_en || ' ', kw_text, '', upper(name_zh), name_zh]) as v,
             unnest([1, 2, 3, 4, 5, 6, 7]) as i from fx_role),
n as (select slug, trim(v) as v, i, row_number() over (partition by slug, lower(trim(v)) order by i) as rn from v where trim(v) <> '')
select slug, string_agg(v, '|' order by i) as kept from n where rn = 1 group by slug""")
def t6(t: Inputs):
    values = F.array(
        F.col("name_en"), F.upper("name_en"), F.concat(F.lit("  "), "name_en", F.lit(" ")), F.col("kw_text"),
        F.lit(""), F.upper("name_zh"), F.col("name_zh"),
    )
    return t.fx_role.select("slug", F.array_join(cat.distinct_ignoring_case(values), "|").alias("kept"))


@query("P37_role_queries", """
with q as (select slug, unnest([name_en, name_zh, name_en || ' AI automation', name_en || ' copilot agent', industry_code || ' AI',
             string_split(kw_text, ' ')[1] || ' AI', string_split(kw_text, ' ')[2] || ' AI', string_split(kw_text, ' ')[3] || ' AI']) as q,
             unnest([1, 2, 3, 4, 5, 6, 7, 8]) as i from fx_role),
d as (select *, row_number() over (partition by slug, lower(q) order by i) as dup from q where q is not null),
f as (select *, row_number() over (partition by slug order by i) as pos from d where dup = 1),
p as (select slug, q, row_number() over (partition by slug order by case when lower(q) like '%ai automation%' then 0
        when lower(q) like '% ai' then 1 else 2 end, q) as query_rank from f where pos <= 8)
select slug, query_rank, q as query_text from p where query_rank <= 3""")
def p37(t: Inputs):
    words = F.split("kw_text", " ")
    r = t.fx_role.select(
        "slug", "name_en", "name_zh", F.array("industry_code").alias("aliases"),
        F.slice(words, 1, rules.TASK_KEYWORDS).alias("tasks"),
    )
    return cat.role_queries(r).select("slug", F.col("query_rank").cast("long").alias("query_rank"), "query_text")


@query("I16_missing_state", f"""
select slug, i_rate as replacement_rate, i_level as risk_level, 'RATED' as rating_status from {profile_sql(PROFILE_ROLES, '0')}
where slug not in (select slug from fx_state)""")
def i16(t: Inputs):
    return cat.missing_state(profile_roles(t), t.fx_state).select(
        "slug", "replacement_rate", "risk_level", "rating_status"
    )


# the old dictionary, and a snapshot which lacks some slugs, renames others and repeats one name's slug
@query("I15_dictionary_import", """
with old as (select slug, name_en, name_zh, industry_code from fx_role where industry_code <> 'Brand#7'),
snap as (select slug, upper(name_en) as name_en, name_zh, 'all-roles' as industry_code, cast(substr(slug, 2) as bigint) as ordinal
         from fx_role where name_en not like 'red%'
         union all select 'shared', name_en, name_zh, 'all-roles', cast(substr(slug, 2) as bigint) from fx_role),
last as (select * from (select *, row_number() over (partition by slug order by ordinal desc) as rn from snap) where rn = 1)
select coalesce(l.slug, o.slug) as slug, case when l.slug is not null then l.name_en else o.name_en end as name_en,
       case when l.slug is not null then l.name_zh else o.name_zh end as name_zh,
       case when l.slug is not null then l.industry_code else o.industry_code end as industry_code, l.slug is not null as is_active
from old o full outer join last l on o.slug = l.slug""")
def i15(t: Inputs):
    r = t.fx_role
    old = r.filter(F.col("industry_code") != "Brand#7").select("slug", "name_en", "name_zh", "industry_code", "is_active")
    ordinal = F.substring("slug", 2, 20).cast("long").alias("ordinal")
    snap = r.filter(~F.startswith("name_en", F.lit("red"))).select(
        "slug", F.upper("name_en").alias("name_en"), "name_zh", F.lit("all-roles").alias("industry_code"), ordinal
    ).unionByName(
        r.select(F.lit("shared").alias("slug"), "name_en", "name_zh", F.lit("all-roles").alias("industry_code"), ordinal)
    )
    return cat.import_dictionary(old, snap)


@query("X3_source_codes", """
select p_partkey, case when p_name = 'red plate' then 'own-1' else concat('csv-role-', row_number() over (order by p_partkey)) end as source_code
from part""")
def x3(t: Inputs):
    names = t.part.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("name_en"))
    coded = source_codes(names, {"red plate": "own-1"}, ("position",))
    return coded.select(F.col("position").alias("p_partkey"), "source_code")


@query("X18_url_list", """
with p as (select concat('/roles/', slug) as path, updated_at as last_modified from fx_role where is_active
   union all select unnest(['', '/methodology', '/topics/a', '/topics/b']), null),
l as (select *, unnest(['en', 'zh']) as loc from p)
select concat('https://site.test/', loc, path) as url, last_modified, concat('https://site.test/en', path) as alternate_en,
  concat('https://site.test/zh', path) as alternate_zh, concat('https://site.test/en', path) as alternate_default from l""")
def x18(t: Inputs):
    return cat.url_list(t.fx_role, "https://site.test/", topics=("a", "b"))


@query("X1_filtered_scan", """
select p_partkey, p_name, p_size from part where p_size between 10 and 20 and p_brand = 'Brand#7'""")
def x1(t: Inputs):
    return t.part.filter(F.col("p_size").between(10, 20) & (F.col("p_brand") == "Brand#7")).select(
        "p_partkey", "p_name", "p_size"
    )


# names of one-line files, two of them preserved roles with the slug of a name, then the import and the names of state rows
@query("I15_dictionary_chain", """
with nm as (select concat(p_name, ' ', p_type) as name_en, row_number() over (order by p_partkey) as ordinal from part),
listed as (select ordinal, concat('csv-role-', ordinal) as source_code, lower(replace(name_en, ' ', '-')) as slug, name_en,
             case when length(name_en) % 3 = 0 then concat(name_en, '-zh') else name_en end as name_zh from nm),
pres as (select concat('kept-', s_suppkey) as source_code, case when s_suppkey = 2 then (select min(slug) from listed) else concat('kept-', s_suppkey) end as slug,
           s_name as name_en, concat(s_name, '-zh') as name_zh from supplier where s_suppkey % 3 = 2),
snap as (select * exclude (rn) from (select *, row_number() over (partition by slug order by ordinal desc) as rn from listed) where rn = 1
   union all select 9000000000000000000, * from pres where slug not in (select slug from listed)),
old as (select distinct lower(concat(p_name, '-', p_type)) as slug, 'old' as source_code, 'Old Name' as name_en, '旧' as name_zh from (
          select replace(p_name, ' ', '-') as p_name, p_type from part) union all select concat('gone-', s_suppkey), 'old', s_name, s_name from supplier),
dict as (select coalesce(n.slug, o.slug) as slug, case when n.slug is not null then n.source_code else o.source_code end as source_code,
   case when n.slug is not null then n.name_en else o.name_en end as name_en, case when n.slug is not null then n.name_zh else o.name_zh end as name_zh,
   n.slug is not null as is_active from old o full outer join snap n on o.slug = n.slug),
st as (select slug, 'Stale' as name_en, '旧名' as name_zh from old)
select d.slug, d.source_code, d.is_active, d.name_en, d.name_zh, case when d.is_active then d.name_en else st.name_en end as state_name_en,
   case when d.is_active then d.name_zh else st.name_zh end as state_name_zh from dict d left join st on st.slug = d.slug""")
def i15_chain(t: Inputs):
    full = F.concat_ws(" ", "p_name", "p_type")
    slug = F.lower(F.replace(full, F.lit(" "), F.lit("-")))
    names = t.part.select(F.col("p_partkey").alias("position"), full.alias("name_en"))
    known = names.select("name_en").distinct().filter(F.length("name_en") % 3 == 0).withColumn("name_zh", F.concat("name_en", F.lit("-zh")))
    first = t.part.agg(F.min(slug).alias("_first"))
    kept = F.concat(F.lit("kept-"), F.col("s_suppkey").cast("string"))
    preserved = t.supplier.filter(F.col("s_suppkey") % 3 == 2).join(F.broadcast(first)).select(
        kept.alias("source_code"), F.lit(None).cast("string").alias("occupation_code"),
        F.when(F.col("s_suppkey") == 2, F.col("_first")).otherwise(kept).alias("slug"), F.col("s_name").alias("name_en"),
        F.concat("s_name", F.lit("-zh")).alias("name_zh"), F.array().cast("array<string>").alias("keywords"))
    snapshot = role_dictionary(names, known, preserved, ("position",))
    old = t.part.select(slug.alias("slug")).distinct().select(
        "slug", F.lit("old").alias("source_code"), F.lit("Old Name").alias("name_en"), F.lit("旧").alias("name_zh"), F.lit(True).alias("is_active")
    ).unionByName(t.supplier.select(
        F.concat(F.lit("gone-"), F.col("s_suppkey").cast("string")).alias("slug"), F.lit("old").alias("source_code"),
        F.col("s_name").alias("name_en"), F.col("s_name").alias("name_zh"), F.lit(True).alias("is_active")))
    dictionary = cut_lineage(cat.import_dictionary(old, snapshot))
    state = old.select("slug", F.lit("Stale").alias("name_en"), F.lit("旧名").alias("name_zh"))
    named = cat.copy_names(state, dictionary).select(
        "slug", F.col("name_en").alias("_en"), F.col("name_zh").alias("_zh"))
    own = F.col("is_active")
    return dictionary.join(named, "slug", "left").select(
        "slug", "source_code", "is_active", "name_en", "name_zh",
        F.coalesce("_en", F.when(own, F.col("name_en"))).alias("state_name_en"), F.coalesce("_zh", F.when(own, F.col("name_zh"))).alias("state_name_zh"))


# beginnings of texts in four languages as names: case, accents, punctuation
@query("W1_names_of_many_scripts", """
with r as (select concat('d', doc_id) as slug, substr(text, 1, 24) as name_en, doc_id % 4 as severity from documents where text is not null)
select slug, row_number() over (order by severity desc, name_en collate "en", slug) as position from r""")
def w1_names(t: Inputs):
    level = F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "SEVERE")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = t.documents.filter(F.col("text").isNotNull()).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"), F.substring("text", 1, 24).alias("name_en"),
        F.substring("text", 1, 24).alias("name_zh"), level.alias("risk_level"))
    return global_positions(rows, cat.display_order()).select("slug", "position")


# what people type: beginnings, words the other way round, letters left out, unknown words and nothing
@query("W20_name_search_join", r"""
with f as (select slug, name_en, trim(regexp_replace(lower(name_en), '[^a-z0-9]+', ' ', 'g')) as a, trim(regexp_replace(lower(name_zh), '[^a-z0-9]+', ' ', 'g')) as b,
             trim(regexp_replace(lower(slug), '[^a-z0-9]+', ' ', 'g')) as c from fx_role),
p as (select p_partkey, lower(p_name) as n from part where p_partkey % 37 = 0),
q as (select distinct trim(q) as q from (
    select case p_partkey % 4 when 0 then substr(n, 1, 2 + p_partkey % 5) when 1 then concat(string_split(n, ' ')[2], ' ', string_split(n, ' ')[1])
      when 2 then regexp_replace(n, '[aeiou ]', '', 'g') else concat(n, ' zz', p_partkey % 3) end as q from p union all select '') where q is not null),
k as (select q, list_filter(string_split(q, ' '), lambda w: w <> '') as words, concat('%', array_to_string(string_split(replace(q, ' ', ''), ''), '%'), '%') as sub from q),
t as (select slug, name_en, unnest([a, b, c]) as t from f),
s as (select q, slug, name_en, max(case when q = '' then 1 when length(t) = 0 then -1 when t = q then 1000 when instr(t, q) = 1 then 900 when instr(t, q) > 1 then 801 - instr(t, q)
    when len(list_filter(words, lambda w: contains(t, w))) = len(words) then 650 - length(t) when replace(t, ' ', '') like sub then 500 - length(t) else -1 end) as score
    from t, k group by q, slug, name_en),
r as (select *, row_number() over (partition by q order by score desc, name_en collate "en", slug) as rn from s where score >= 0)
select q, slug, cast(score as bigint) as score from r where rn <= case when q = '' then 6 else 8 end""")
def w20_join(t: Inputs):
    from tidemark.functions.text import fold_unicode

    folded = t.fx_role.select("slug", "name_en", *[fold_unicode(F.col(c)).alias(f"f_{c}") for c in ("name_en", "name_zh", "slug")])
    name, key = F.lower("p_name"), F.col("p_partkey")
    word = F.split(name, " ")
    typed = (
        F.when(key % 4 == 0, F.substring(name, F.lit(1), (2 + key % 5).cast("int"))).when(key % 4 == 1, F.concat(word[1], F.lit(" "), word[0]))
        .when(key % 4 == 2, F.regexp_replace(name, "[aeiou ]", "")).otherwise(F.concat(name, F.lit(" zz"), (key % 3).cast("string"))))
    queries = t.part.filter(key % 37 == 0).select(typed.alias("query")).unionByName(t.part.agg(F.lit("").alias("query")))
    return cat.search_join(folded, queries, ("f_name_en", "f_name_zh", "f_slug"), "name_en").select(
        F.col("query").alias("q"), "slug", F.col("score").cast("long").alias("score"))
