"""The whole ingest over the given pages: extraction, intake, matching, classification, stored rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.plans import run as whole
from tidemark.session import new_state_dir
from tidemark.workload.matching import GATED, lex
from tidemark.workload.registry import Inputs, query
from tidemark.workload.text import FX_NOISE, FX_WORKFLOW, _gate_sql

TRANSPORTS = ("articles", "classed", "headings", "anchors", "json")
MODELS = (rules.DEFAULT_MODEL, "stub:m")


def listing_pages(t: Inputs):
    """Every given page with a list of two cards before it, as the transport of its source expects."""
    names = t.fx_role.select(F.col("slug").alias("_slug"), F.col("name_en").alias("_name"))
    n = t.fx_role.count()
    page = F.col("page_id")

    def s(c):
        return c.cast("string")

    def cat(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    rows = t.pages.withColumn("_slug", cat("r", s(F.floor(page / 2) % n + 1))).join(names, "_slug")

    def card(i: int):
        href = cat("/a/", s(F.floor(page / 2).cast("long")), "/", F.when(page % 3 == 0, "0").otherwise(str(i)))
        title = cat(f"Workflow update {i} for ", F.col("_name"), " team ", s(page))
        day = F.when(page == 6, "soon").otherwise(f"2024-05-0{i + 1}")
        time, text = cat('<time datetime="', day, '">then</time>'), cat("<p>Plan ", s(page % 10), "</p>")
        return {
            "articles": cat('<article><a href="', href, '"><h2>', title, "</h2></a>", time, text, "</article>"),
            "classed": cat('<li class="post-card"><a href="', href, '"><h3>', title, "</h3></a>", time, text, "</li>"),
            "headings": cat('<h2><a href="', href, '">', title, "</a></h2>", time, text),
            "anchors": cat('<a href="', href, '">', title, "</a>", time, text),
            "json": cat('{"title": "', title, '", "url": "', href, '", "date": "', day, '", "summary": "Plan ', s(page % 10), '"}'),
        }

    first, second = card(0), card(1)
    # a source has one transport
    kind = F.element_at(F.array(*[F.lit(x) for x in TRANSPORTS]), (page % 7 % 5 + 1).cast("int"))
    head = F.lit("<section>")
    for name in TRANSPORTS[:-1]:
        head = F.when(kind == name, cat("<html><body><section>", first[name], "\n", second[name], "</section></body></html>")).otherwise(head)
    head = F.when(kind == "json", cat('<script id="__NEXT_DATA__">{"pageProps": [', first["json"], ", ", second["json"], "]}</script>")).otherwise(head)
    number = page % 7
    return rows.select(
        "page_id", kind.alias("transport"), F.lit("https://news.test/list").alias("base_url"), F.concat(head, "html").alias("html"),
        number.alias("source_ord"), cat("src", s(number)).alias("source_catalog_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("COMPANY_UPDATE", "BLOG", "NEWS", "JOB_POSTING")]), (number % 4 + 1).cast("int")).alias("source_type"),
        F.when(number % 4 <= 1, "official").when(number % 4 == 3, "jobs").otherwise("media").alias("source_class"),
        F.when(number == 3, "direct_mapped").otherwise("observe_only").alias("mapping_mode"),
        F.when(number == 3, "r3").alias("source_role_slug"))


def model(batch):
    """Stands in for a model, by the title: first candidate, none, a role outside, or an error."""
    import json

    import pandas as pd

    if (batch["title"].str.len() % 4 == 3).any():
        raise ValueError("model is down")
    results = [json.dumps({
        "assignedRoleSlug": {0: slugs[0], 1: None, 2: "r-outside"}[len(title) % 4], "sourceKind": "official", "signalType": "adoption_case",
        "relevance": "none" if len(title) % 4 == 1 else "high", "impactDirection": "increase", "explanation": "seen", "summaryEn": "short",
        "summaryZh": None, "signalWeight": "primary"}) for title, slugs in zip(batch["title"], batch["candidate_slugs"])]
    return pd.DataFrame({"item_id": batch["item_id"], "result": results, "provider": "stub", "model": "m"})


KIND = "case source_ord % 4 when 0 then 'COMPANY_UPDATE' when 1 then 'BLOG' when 2 then 'NEWS' else 'JOB_POSTING' end"
INGESTED = f"""n as (select count(*) as n from fx_role),
card as (select page_id, i, page_id % 7 as source_ord, concat('https://news.test/a/', page_id // 2, '/', case when page_id % 3 = 0 then 0 else i end) as source_url,
     concat('Workflow update ', i, ' for ', name_en, ' team ', page_id) as title, concat('Plan ', page_id % 10) as summary, page_id = 6 as bad
   from pages, n, unnest([0, 1]) c(i), fx_role where slug = concat('r', (page_id // 2) % n.n + 1)),
one as (select source_ord, source_url, arg_max(title, page_id * 2 + i) as title, arg_max(summary, page_id * 2 + i) as summary,
     arg_max(bad, page_id * 2 + i) as bad, min(page_id * 2 + i) as first_position from card group by source_ord, source_url),
good as (select * from one where source_ord not in (select source_ord from one where bad)),
ing as (select concat('src', source_ord, chr(31), source_url) as item_id, concat('src', source_ord) as source_catalog_id, source_url, {KIND} as source_type,
     title, summary, '' as hint_text, source_ord from (select *, row_number() over (partition by source_url order by source_ord, first_position) as rn from good) where rn = 1)"""


def _stored_sql() -> str:
    gated = GATED.replace("fx_item", "ing")
    return f"""with {INGESTED},
{gated},
tops as (select item_id, slug as top_slug, score, matched from cand where candidate_rank = 1),
ctx as (select i.*, top_slug, regexp_matches(title || ' ' || summary, '{_gate_sql(FX_WORKFLOW)}') and (matched >= 2 or (matched >= 1 and score >=
            case when source_type = 'NEWS' then 5.5 else 3.5 end)) as lifts from ing i left join tops using (item_id)),
rt as (select *, case when top_slug is null then 'no_candidate' when length(title) % 4 = 3 then 'error' when length(title) % 4 = 1 then
          case when lifts then 'promoted' else 'unassigned' end when length(title) % 4 = 0 then 'model' else 'outside' end as route from ctx),
cls as (select *, case route when 'model' then top_slug when 'promoted' then top_slug when 'error' then case when lifts then top_slug end end as own from rt),
fin as (select *, coalesce(own, case when source_ord = 3 then 'r3' end) as slug from cls)"""


@query("I5_ingest_chain", f"""{_stored_sql()}
select source_catalog_id, source_url, title, summary, route in ('model', 'promoted', 'unassigned', 'outside') as cached_later,
  case when slug is null then 'UNMATCHED' else 'ACCEPTED' end as decision_status, slug as decision_slug,
  case when source_ord = 3 then 'APPROVED' else 'PENDING' end as review_status,
  case when route <> 'no_candidate' then coalesce(slug, 'unmapped') end as inferred_slug
from fin""")
def i5_chain(t: Inputs):
    root = new_state_dir(t.spark, "ingest")
    inputs = {"pages": listing_pages(t), "lex": lex(t), "roles": t.fx_role, "state": t.fx_state, "model": model, "models": MODELS,
              "noise": FX_NOISE, "workflow": FX_WORKFLOW}
    whole.run_once(t.spark, root, 1, inputs, datetime(2024, 6, 1))
    # the second run meets what the first one stored
    tables, classified = whole.run_once(t.spark, root, 2, inputs, datetime(2024, 6, 2))
    return (
        tables.items.select("item_id", "source_catalog_id", "source_url", "title", F.col("summary_en").alias("summary"))
        .join(tables.decisions.select("item_id", "decision_status", "decision_slug", "review_status"), "item_id")
        .join(tables.inferences.select("item_id", "inferred_slug"), "item_id", "left")
        .join(classified.select("item_id", F.col("cache_hit").alias("cached_later")), "item_id").drop("item_id")
    )
