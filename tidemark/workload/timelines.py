"""Timelines, their merge, readers of the item star and the role detail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import catalogue as cat
from tidemark.operators import timeline as tl
from tidemark.operators.ranking import top_k
from tidemark.operators.trend import trend
from tidemark.plans.detail import role_detail
from tidemark.workload.catalogue import _resolved, roles
from tidemark.workload.registry import Inputs, query

MEMBER = """mem as (select *, decision_slug as slug from fx_evidence where decision_status = 'ACCEPTED' and decision_slug is not null
   union all select *, role_slug from fx_evidence where decision_status = 'ACCEPTED'
     and role_slug is distinct from decision_slug)"""
BARE = r"regexp_replace(lower(regexp_extract(source_url, '^https?://([^/:?#]+)', 1)), '^www\.', '')"
LINE = f"""{MEMBER},
   ranked as (select *, row_number() over (partition by slug order by published_at desc, item_id) as timeline_rank from mem
      where not (lower(source_url) like '%example.com%')),
   line as (select *, {BARE} as source_host from ranked where timeline_rank <= 10)"""


@query("J6_timeline_membership", f"with {MEMBER} select item_id, slug from mem")
def j6(t: Inputs):
    return tl.memberships(t.fx_evidence).select("item_id", "slug")


@query("W6_newest_per_role", f"""
with {LINE}
select slug, timeline_rank, item_id, source_host, coalesce(inference_summary_en, summary_en) as shown_summary,
       coalesce(inference_summary_en, summary_en) as rationale from line where source_host <> 'example.com'""")
def w6(t: Inputs):
    items = t.fx_evidence.withColumn("reason", F.lit(None).cast("string"))
    rows = tl.timelines(items).withColumns(tl.timeline_texts())
    return rows.select(
        "slug", F.col("timeline_rank").cast("long").alias("timeline_rank"), "item_id", "source_host",
        "shown_summary", "rationale",
    )


@query("J7_item_star", """
select e.item_id, e.decision_status, s.slug is not null as role_known, s.name_en as role_name_en
from fx_evidence e left join fx_state s on e.decision_slug = s.slug""")
def j7(t: Inputs):
    rows = tl.star(t.fx_evidence, t.fx_state)
    return rows.select(
        "item_id", "decision_status", F.coalesce("role_known", F.lit(False)).alias("role_known"), "role_name_en"
    )


MERGED_SQL = f"""
with {MEMBER},
sg as (select role_slug as slug, source_url as url, item_id as row_id, 'signal' as label, null as title,
         concat('S ', summary_en) as summary, published_at from fx_evidence where source_type = 'BLOG'),
it as (select slug, source_url as url, item_id as row_id, null as label, title, inference_summary_en as summary, published_at from mem),
ds as (select role_slug as slug, concat(source_url, case when source_type = 'NEWS' then '' else '?d' end) as url,
         concat('d', item_id) as row_id, 'Role Search' as label, title, summary_en as summary, published_at
       from fx_evidence where starts_with(source_catalog_id, 'discovery-')),
a0 as (select *, row_number() over (partition by slug order by published_at desc, row_id) as p from sg),
b0 as (select *, row_number() over (partition by slug order by published_at desc, row_id) as p from it),
c0 as (select *, row_number() over (partition by slug order by published_at desc, row_id) as p from ds),
a1 as (select *, row_number() over (partition by slug, url order by p desc) as q from a0 where p <= 10
        and {BARE.replace('source_url', 'url')} <> 'example.com'),
b1 as (select *, row_number() over (partition by slug, url order by p desc) as q from b0 where p <= 10
        and {BARE.replace('source_url', 'url')} <> 'example.com'),
c1 as (select *, row_number() over (partition by slug, url order by p desc) as q from c0 where p <= 10),
f as (select coalesce(b.slug, a.slug) as slug, coalesce(b.url, a.url) as url, coalesce(b.row_id, a.row_id) as row_id,
        coalesce(b.label, a.label) as label, coalesce(b.title, a.title) as title, coalesce(b.summary, a.summary) as summary,
        coalesce(b.published_at, a.published_at) as published_at
      from (select * from a1 where q = 1) a full outer join (select * from b1 where q = 1) b on a.slug = b.slug and a.url = b.url),
k as (select * from (select *, row_number() over (partition by slug order by published_at desc, row_id) as r from f) where r <= 10),
u as (select slug, url, row_id, label, title, summary, published_at from k
      union all select slug, url, row_id, label, title, summary, published_at from c1 where q = 1
        and not exists (select 1 from k where k.slug = c1.slug and k.url = c1.url)),
w as (select *, row_number() over (partition by slug order by published_at desc, row_id) as timeline_rank from u)"""


@query("J13_merged_timeline", f"""{MERGED_SQL}
select slug, timeline_rank, row_id, label, title, summary from w where timeline_rank <= 10""")
def j13(t: Inputs):
    return merged(t).select(
        "slug", F.col("timeline_rank").cast("long").alias("timeline_rank"), "row_id", "label", "title", "summary"
    )


def merged(t: Inputs):
    e = t.fx_evidence
    none = F.lit(None).cast("string")
    signals = e.filter(F.col("source_type") == "BLOG").select(
        F.col("role_slug").alias("slug"), F.col("source_url").alias("url"), F.col("item_id").alias("row_id"),
        none.alias("title"), F.lit("signal").alias("label"), F.concat(F.lit("S "), "summary_en").alias("summary"),
        "published_at",
    )
    items = tl.memberships(e).select(
        "slug", F.col("source_url").alias("url"), F.col("item_id").alias("row_id"), "title", none.alias("label"),
        F.col("inference_summary_en").alias("summary"), "published_at",
    )
    suffix = F.when(F.col("source_type") == "NEWS", "").otherwise("?d")
    discovery = e.filter(F.startswith("source_catalog_id", F.lit("discovery-"))).select(
        F.col("role_slug").alias("slug"), F.concat("source_url", suffix).alias("url"),
        F.concat(F.lit("d"), "item_id").alias("row_id"), "title", F.lit("Role Search").alias("label"),
        F.col("summary_en").alias("summary"), "published_at",
    )
    return tl.merged_timeline(signals, items, discovery)


@query("W7_merged_newest", f"""{MERGED_SQL}
select slug, count(*) as n, max(published_at) as latest, max(timeline_rank) as last_rank from w where timeline_rank <= 10 group by slug""")
def w7(t: Inputs):
    return merged(t).groupBy("slug").agg(
        F.count("*").alias("n"), F.max("published_at").alias("latest"), F.max("timeline_rank").alias("last_rank")
    )


SUB_BOUND = "select email, slug, coalesce(last_alert_at, created_at) as boundary from fx_sub"


@query("J11_items_since_boundary", f"""
with {MEMBER}, b as ({SUB_BOUND}),
x as (select b.email, b.slug, m.item_id, row_number() over (partition by b.email, b.slug order by m.published_at desc, m.item_id) as rn
      from b join mem m on b.slug = m.slug and m.published_at > b.boundary and not (lower(m.source_url) like '%example.com%'))
select email, slug, item_id from x where rn <= 3""")
def j11(t: Inputs):
    line = tl.timelines(t.fx_evidence, 3)
    bounds = t.fx_sub.select("email", "slug", F.coalesce("last_alert_at", "created_at").alias("boundary"))
    return tl.since_boundaries(line, bounds, 3).select("email", "slug", "item_id")


@query("J12_latest_signal", """
with l as (select *, row_number() over (partition by role_slug order by published_at desc, item_id desc) as rn
           from fx_evidence where source_type = 'BLOG')
select s.email, s.slug, l.item_id, l.published_at from fx_sub s left join l on s.slug = l.role_slug and l.rn = 1""")
def j12(t: Inputs):
    latest = tl.latest_signals(blog_signals(t))
    return t.fx_sub.join(latest, "slug", "left").select(
        "email", "slug", F.col("latest.item_id").alias("item_id"), F.col("latest.published_at").alias("published_at")
    )


def blog_signals(t: Inputs):
    return t.fx_evidence.filter(F.col("source_type") == "BLOG").select(
        F.col("role_slug").alias("slug"), "published_at", "item_id", "summary_en"
    )


@query("I20_watchlist", """
with l as (select *, row_number() over (partition by role_slug order by published_at desc, item_id desc) as rn
           from fx_evidence where source_type = 'BLOG')
select lower(trim(s.email)) as email, s.slug, r.name_en, r.risk_level, r.replacement_rate, l.summary_en as latest_summary, s.created_at
from fx_sub s join fx_state r on s.slug = r.slug left join l on s.slug = l.role_slug and l.rn = 1""")
def i20(t: Inputs):
    from tidemark.operators.notices import watchlists

    return watchlists(t.fx_sub, t.fx_state, blog_signals(t)).select(
        "email", "slug", "name_en", "risk_level", "replacement_rate", "latest_summary", "created_at",
    )


@query("P43_provenance", f"""
select item_id, coalesce(inference_summary_en, source_type) as shown_label, nullif({BARE}, '') as source_host,
       strftime(published_at, '%Y-%m-%d') as shown_date from fx_evidence""")
def p43(t: Inputs):
    return t.fx_evidence.select(
        "item_id", F.coalesce("inference_summary_en", "source_type").alias("shown_label"),
        urls.host(F.col("source_url")).alias("source_host"),
        F.date_format("published_at", "yyyy-MM-dd").alias("shown_date"),
    )


@query("I21_item_readers", """
with j as (select e.*, s.slug is not null as known from fx_evidence e left join fx_state s on e.decision_slug = s.slug),
a as (select item_id from j where review_status = 'PENDING' and known and decision_status = 'ACCEPTED'
      order by published_at desc, item_id limit 20),
b as (select item_id from j where inference_summary_en is not null order by published_at desc, item_id limit 20),
c as (select item_id from j where decision_status = 'ACCEPTED' and not (lower(source_url) like '%example.com%')
      and (known or inference_summary_en is not null) order by published_at desc, item_id limit 6)
select 'queue' as reader, item_id from a union all select 'diagnostics', item_id from b union all select 'recent', item_id from c""")
def i21(t: Inputs):
    rows = tl.star(t.fx_evidence, t.fx_state).withColumn("role_known", F.coalesce("role_known", F.lit(False)))

    def named(name, df):
        return df.select(F.lit(name).alias("reader"), "item_id")

    return (
        named("queue", tl.review_queue(rows))
        .unionByName(named("diagnostics", tl.inference_diagnostics(rows)))
        .unionByName(named("recent", tl.recent_approved(rows)))
    )


@query("W17_recent_snapshots", """
with r as (select *, row_number() over (partition by role_id order by snapshot_at desc, snapshot_id) as rn from fx_snapshot)
select role_id, snapshot_id, rate, rn from r where rn <= 6""")
def w17(t: Inputs):
    order = [F.col("snapshot_at").desc(), F.col("snapshot_id").asc()]
    return top_k(t.fx_snapshot, ["role_id"], order, 6, rank="rn").select(
        "role_id", "snapshot_id", "rate", F.col("rn").cast("long").alias("rn")
    )


@query("I17_role_detail", f"""{MERGED_SQL},
items as (select slug, count(*) as n, max(published_at) as latest, string_agg(row_id, ',' order by timeline_rank) as ids
          from w where timeline_rank <= 10 group by slug),
d as (select *, string_split(kw_text, ' ') as kw from fx_role),
pr as (select a.slug as base_slug, b.slug as related_slug, b.name_en, case when b.name_zh <> b.name_en then 0 else 1 end as un,
        len(list_filter(a.kw, lambda x: list_contains(b.kw, x))) as overlap
      from d a join d b on a.industry_code = b.industry_code and a.slug <> b.slug and b.is_active),
rr as (select *, row_number() over (partition by base_slug order by overlap desc, un, name_en, related_slug) as rk from pr),
near as (select base_slug as slug, string_agg(related_slug, ',' order by rk) as related from rr where rk <= 6 group by base_slug),
tr as (select concat('r', role_id) as slug, strftime(snapshot_at + interval 8 hour, '%Y-%m') as bucket,
         cast(floor(avg(rate) + 0.5) as bigint) as average_rate from fx_snapshot where rate is not null group by 1, 2),
trs as (select slug, string_agg(concat(bucket, '=', average_rate), ',' order by bucket) as months from tr group by slug)
select s.slug, coalesce(n, 0) as timeline_count, latest as latest_published_at, ids as timeline, related, months,
   {_resolved('s.risk_summary_en', 'coalesce(n, 0)', 'en')} as risk_summary_en
from fx_state s left join items using (slug) left join near using (slug) left join trs using (slug)""")
def i17(t: Inputs):
    line = merged(t).select("slug", "timeline_rank", F.col("row_id").alias("url"), "title", "published_at")
    points = trend(t.fx_snapshot).select(F.concat(F.lit("r"), "role_id").alias("slug"), "grain", "bucket", "average_rate", "points")
    d = role_detail(t.fx_state, line, cat.related_roles(roles(t), 6), points)

    def joined(column, text):
        return F.when(F.col(column).isNotNull(), F.array_join(F.transform(column, text), ","))

    months = F.filter("trend", lambda p: p["grain"] == "month")
    return d.select(
        "slug", F.col("timeline_count").cast("long").alias("timeline_count"), "latest_published_at",
        joined("timeline", lambda x: x["url"]).alias("timeline"),
        joined("related", lambda x: x["related_slug"]).alias("related"),
        F.when(F.col("trend").isNotNull(), F.array_join(
            F.transform(months, lambda p: F.concat(p["bucket"], F.lit("="), p["average_rate"].cast("string"))), ","
        )).alias("months"),
        "risk_summary_en",
    )
