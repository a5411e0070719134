"""Canonical URLs, hosts, page types and the two-level dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators.intake import normalise_fetch
from tidemark.operators.ranking import first_per_key, last_value_first_position
from tidemark.workload.registry import Inputs, query

# the canonical form in plain SQL, for URLs without user info and dot segments
_Q = r"regexp_extract(u, '^[^?#]*(\?[^#]*)', 1)"
CANON = rf"""concat(lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)), '://',
    regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', ''),
    regexp_extract(u, '^[a-zA-Z]+://[^/?#:]+(:\d+)', 1),
    case when regexp_extract(u, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1) = '' then '/'
         else regexp_extract(u, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1) end,
    case when len(list_filter(string_split(substr({_Q}, 2), '&'), lambda p: regexp_matches(p, '^(?i)(utm_[^=]*|spm|from|ref)(=|$)'))) = 0
         then {_Q}
         when len(list_filter(string_split(substr({_Q}, 2), '&'), lambda p: not regexp_matches(p, '^(?i)(utm_[^=]*|spm|from|ref)(=|$)'))) = 0
         then ''
         else '?' || array_to_string(list_filter(string_split(substr({_Q}, 2), '&'),
              lambda p: not regexp_matches(p, '^(?i)(utm_[^=]*|spm|from|ref)(=|$)')), '&') end,
    regexp_extract(u, '(#.*)$', 1))"""
HOST = r"regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"


@query("P1_canonical_url", f"select idx, {CANON} as key from (select idx, source_url as u from fx_fetch)")
def p1(t: Inputs):
    return t.fx_fetch.select("idx", urls.canonical(F.col("source_url")).alias("key"))


@query("P2_host", f"select idx, nullif({HOST}, '') as host from (select idx, source_url as u from fx_fetch union all select page_id, html from pages)")
def p2(t: Inputs):
    both = t.fx_fetch.select("idx", "source_url").unionByName(
        t.pages.select(F.col("page_id").alias("idx"), F.col("html").alias("source_url"))
    )
    return both.select("idx", urls.host(F.col("source_url")).alias("host"))


@query("P3_public_url", f"select item_id, {HOST} not in ('', 'example.com') as public from (select item_id, source_url as u from fx_evidence)")
def p3(t: Inputs):
    return t.fx_evidence.select("item_id", urls.is_public(F.col("source_url")).alias("public"))


@query("P4_mentions_example", "select page_id from pages where not (lower(url) like '%example.com%')")
def p4(t: Inputs):
    return t.pages.filter(~urls.mentions_example(F.col("url"))).select("page_id")


@query("P12_resolve_link", r"""
with l as (select page_id, url, unnest(['/abs/x', '//cdn.test/y', 'https://Other.test', '?q=1', 'rel/z']) as link from pages),
b as (select *, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin, regexp_extract(url, '^(https?):', 1) as scheme,
        case when regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) = '' then '/'
             else regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) end as path from l)
select page_id, link, case when link like 'https:%' then 'https://other.test/' when link like '//%' then scheme || ':' || link
   when link like '/%' then origin || link when link like '?%' then origin || path || link
   else origin || regexp_replace(path, '[^/]*$', '') || link end as resolved from b""")
def p12(t: Inputs):
    links = F.array(*[F.lit(x) for x in ("/abs/x", "//cdn.test/y", "https://Other.test", "?q=1", "rel/z")])
    exploded = t.pages.select("page_id", "url", F.explode(links).alias("link"))
    return exploded.select("page_id", "link", urls.resolve(F.col("link"), F.col("url")).alias("resolved"))


@query("P31_page_types", r"""
with h as (select hit_id, url, lower(title) as ti, published is null as undated,
   regexp_extract(url, '^https://([^/]+)', 1) as host,
   list_filter(string_split(regexp_extract(url, '^https://[^/]+(/.*)$', 1), '/'), lambda s: length(s) > 0) as seg from fx_hit),
f as (select *, len(seg) as n, (ti like '%#1%' or ti like '%software%' or ti like '%platform%' or ti like '%powered%'
   or ti like '%for small businesses%' or ti like '%blog & resources%' or ti like '%chatbot%') as marketing from h)
select hit_id,
  n = 0 or (n = 1 and regexp_matches(seg[1], '^(?i)[a-z]{2}(-[a-z]{2})?$')) or (n = 1 and seg[1] = 'blog')
    or (undated and n <= 1 and marketing) as landing,
  undated and (n <= 1 or ((ti like '%will %' or ti like '%future of%' or ti like '%what does ai mean%'
    or ti like '%not obsolete%' or ti like '%more valuable%') and not list_has_any(list_transform(seg, lambda s: lower(s)),
    ['article','articles','blog','insights','news','press','resource','resources','stories','update','updates']))) as evergreen,
  undated and (host = 'bls.gov' or host like '%.bls.gov' or ti like '%job profile%') as reference,
  undated and list_has_any(list_transform(seg, lambda s: lower(s)), ['industry','industries']) and marketing as vertical
from f""")
def p31(t: Inputs):
    typed = urls.with_page_types(t.fx_hit, F.col("url"), F.col("title"), F.col("published"))
    return typed.select("hit_id", "landing", "evergreen", "reference", "vertical")


KEYED = f"keyed as (select *, {CANON} as key from (select *, source_url as u from fx_fetch))"


@query("W11_last_value_first_position", f"""
with {KEYED},
g as (select source_ord, key, min(idx) as first_position, max(idx) as last_idx from keyed group by source_ord, key)
select g.source_ord, g.key, g.first_position, k.idx as last_idx, k.title from g
join keyed k on k.source_ord = g.source_ord and k.key = g.key and k.idx = g.last_idx""")
def w11(t: Inputs):
    keyed = t.fx_fetch.withColumn("key", urls.canonical(F.col("source_url")))
    out = last_value_first_position(
        keyed.select("source_ord", "key", "idx", "title"), ["source_ord", "key"], "idx"
    )
    return out.select("source_ord", "key", "first_position", F.col("idx").alias("last_idx"), "title")


@query("W12_first_source_wins", f"""
with {KEYED}, r as (select *, row_number() over (partition by key order by source_ord, idx) as rn from keyed)
select key, source_ord, idx from r where rn = 1""")
def w12(t: Inputs):
    keyed = t.fx_fetch.withColumn("key", urls.canonical(F.col("source_url")))
    return first_per_key(keyed, ["key"], [F.col("source_ord"), F.col("idx")]).select("key", "source_ord", "idx")


@query("I1_normalised_fetch", f"""
with {KEYED},
g as (select source_ord, key, min(idx) as pos, max(idx) as last_idx from keyed group by source_ord, key),
v as (select g.source_ord, g.key, g.pos, k.title, k.source_url, k.published from g
      join keyed k on k.source_ord = g.source_ord and k.idx = g.last_idx),
ok as (select * from v where source_ord not in (select source_ord from v where published = 'soon')),
r as (select *, row_number() over (partition by key order by source_ord, pos) as rn from ok)
select source_ord, source_url, trim(title) as title,
       case published when 'May 3, 2024' then timestamp '2024-05-03 00:00:00'
            when '2024-05-02' then timestamp '2024-05-02 00:00:00'
            else timestamp '2024-05-01 10:00:00' end as published_at
from r where rn = 1""")
def i1(t: Inputs):
    items = t.fx_fetch.select(
        "idx", "source_ord", F.concat(F.lit("catalog-"), F.col("source_ord")).alias("source_catalog_id"),
        "source_url", "title", F.lit("").alias("summary"), "published",
    )
    return normalise_fetch(items).items.select("source_ord", "source_url", "title", "published_at")
