"""Feeds, pages and search results; the markup is derived from the orders table, one page per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import html as h
from tidemark.functions.dates import parse_or, parse_timestamp
from tidemark.session import new_state_dir
from tidemark.sources import feeds, pages
from tidemark.sources.dictionary import read_names
from tidemark.workload.registry import Inputs, query

BASE = "https://site.test/list/index.html"
# one to four cards per order: link, title, date and summary vary with the card
CARD_SQL = """cards as (select o_orderkey as page_id, i, concat('Order ', o_orderkey, ' part ', i, ' & ', o_orderpriority) as title,
    case i % 3 when 0 then concat('https://site.test/d/', o_orderkey, '/', i) when 1 then concat('https://www.cdn.test/x/', o_orderkey, '-', i, '?utm_source=f')
      else concat('https://site.test/list/rel/', o_orderkey, '-', i) end as url,
    case i % 3 when 0 then concat('2024-03-0', i + 1) when 1 then concat('March ', i + 1, ', 2024') end as published,
    concat('Sum ', o_orderstatus, ' ', i) as summary from orders, unnest(range(1 + o_orderkey % 4)) t(i))"""


def _s(c):
    return c.cast("string")


def _href(i):
    key = _s(F.col("o_orderkey"))
    return (
        F.when(i % 3 == 0, F.concat(F.lit("/d/"), key, F.lit("/"), _s(i)))
        .when(i % 3 == 1, F.concat(F.lit("https://www.cdn.test/x/"), key, F.lit("-"), _s(i), F.lit("?utm_source=f")))
        .otherwise(F.concat(F.lit("rel/"), key, F.lit("-"), _s(i)))
    )


def _title(i):
    return F.concat(F.lit("Order "), _s(F.col("o_orderkey")), F.lit(" part "), _s(i), F.lit(" &amp; "), F.col("o_orderpriority"))


def _date(i):
    return (
        F.when(i % 3 == 0, F.concat(F.lit('<time datetime="2024-03-0'), _s(i + 1), F.lit('">soon</time>')))
        .when(i % 3 == 1, F.concat(F.lit("<span>March "), _s(i + 1), F.lit(", 2024</span>")))
        .otherwise(F.lit("<i>no date</i>"))
    )


def _summary(i):
    return F.concat(F.lit("Sum "), F.col("o_orderstatus"), F.lit("  <b>"), _s(i), F.lit("</b>"))


def listing(t: Inputs, card, head="<html><body>", tail="</body></html>"):
    cards = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int")), card)
    text = F.concat(F.lit(head), F.array_join(cards, "\n"), F.lit(tail))
    return t.orders.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("base_url"), text.alias("html"))


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


OUT = ("page_id", "source_url", "title", "published", "summary")
SELECT = "select page_id, url as source_url, title, published, summary from cards"


@query("X5_article_cards", f"with {CARD_SQL} {SELECT} where published is not null")
def x5(t: Inputs):
    card = lambda i: _cat('<article class="a"><a class="l" href="', _href(i), '"><h2>', _title(i), "</h2></a>", _date(i), "<p>", _summary(i), "</p></article>")
    return pages.article_cards(listing(t, card)).select(*OUT)


@query("X5_article_cards_with_fallback", f"""
with {CARD_SQL} select page_id, url as source_url, title, coalesce(published, '2024-09-09') as published, summary from cards""")
def x5_fallback(t: Inputs):
    card = lambda i: _cat("<article><a href='", _href(i), "'>", _title(i), "</a>", _date(i), "<div>", _summary(i), "</div></article>")
    return pages.article_cards(listing(t, card), fallback="2024-09-09").select(*OUT)


@query("X6_classed_cards", f"with {CARD_SQL} {SELECT} where published is not null")
def x6(t: Inputs):
    def card(i):
        flat = _cat('<li class="x post-card y"><a href="', _href(i), '"><h3>', _title(i), "</h3></a>", _date(i), "<p>", _summary(i), "</p></li>")
        nested = _cat('<div class="entry-card"><div class="meta">m<div>deep</div></div><a href="', _href(i), '"><h3>', _title(i), "</h3></a>", _date(i), '<div class="teaser">', _summary(i), "</div></div>")
        return F.when(i % 2 == 0, flat).otherwise(nested)

    return pages.classed_cards(listing(t, card)).select(*OUT)


@query("X7_heading_cards", f"with {CARD_SQL} {SELECT} where published is not null and i <> 3")
def x7(t: Inputs):
    card = lambda i: _cat('<h2 class="t"> <a href="', _href(i), '">', _title(i), " Tag: x</a> </h2>", _date(i), "<p>", _summary(i), "</p>", F.when(i == 3, "<em>Sponsored</em>").otherwise(""))
    return pages.heading_cards(listing(t, card)).select(*OUT)


@query("X8_anchor_cards", f"with {CARD_SQL} {SELECT} where published is not null")
def x8(t: Inputs):
    card = lambda i: _cat('<a href="', _href(i), '">', _title(i), "</a>", _date(i), "<p>", _summary(i), "</p>")
    return pages.anchor_cards(listing(t, card)).select(*OUT)


def _json_card(i, names):
    title = F.concat(F.lit("Order "), _s(F.col("o_orderkey")), F.lit(" part "), _s(i), F.lit(" & "), F.col("o_orderpriority"))
    date = F.when(i % 3 == 0, F.concat(F.lit("2024-03-0"), _s(i + 1))).when(i % 3 == 1, _cat("March ", _s(i + 1), ", 2024"))
    summary = F.concat(F.lit("Sum "), F.col("o_orderstatus"), F.lit(" "), _s(i))
    return F.struct(*[c.alias(n) for n, c in zip(names, (title, _href(i), date, summary))])


@query("X9_embedded_json", f"with {CARD_SQL} {SELECT} where published is not null")
def x9(t: Inputs):
    cards = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int")),
                        lambda i: F.struct(F.struct(_json_card(i, ("headline", "slug", "createdAt", "dek")).alias("deep")).alias("node")))
    body = F.to_json(F.struct(F.struct(cards.alias("list")).alias("pageProps")))
    text = _cat('<html><script>var x = {"pageProps": broken}</script><script id="__NEXT_DATA__">window.d = ', body, ";</script></html>")
    p = t.orders.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("base_url"), text.alias("html"))
    return pages.json_items(p).select(*OUT)


@query("X9_flat_records", f"""
with {CARD_SQL} select page_id, case when i = 3 then concat('https://site.test/news/', page_id) else url end as source_url, title, published, summary
from cards where published is not null""")
def x9_flat(t: Inputs):
    def record(i):
        c = _json_card(i, ("title", "vurl", "addtime", "subtitle"))
        return F.struct(F.col("o_orderkey").alias("Id"), c["title"].alias("title"), F.when(i != 3, c["vurl"]).alias("vurl"),
                        c["addtime"].alias("addtime"), c["subtitle"].alias("subtitle"))

    cards = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int")), record)
    body = F.replace(F.to_json(cards), F.lit('"'), F.lit('\\"'))
    text = _cat("<html><script>push(", body, ")</script></html>")
    p = t.orders.select(F.col("o_orderkey").alias("page_id"), F.lit(BASE).alias("base_url"), text.alias("html"))
    return pages.flat_record_items(p).select(*OUT)


@query("X10_job_cards", f"""
with {CARD_SQL} select page_id, url as source_url, title, case when i % 3 = 0 then published else concat('2024-03-0', i + 1, 'T00:00:00.000Z') end as published,
   case when i % 3 = 0 then 'T1 • Ops • Berlin • soon' else concat('Ops • March ', i + 1, ', 2024') end as summary from cards where i % 3 < 2""")
def x10(t: Inputs):
    def card(i):
        time = F.when(i % 3 == 0, _cat('<time datetime="2024-03-0', _s(i + 1), '">soon</time>')).when(
            i % 3 == 1, _cat("<time>March ", _s(i + 1), ", 2024</time>")).otherwise("<time>later</time>")
        place = F.when(i % 3 == 0, "<p>Location: Berlin</p>").otherwise("")
        team = F.when(i % 3 == 0, ' data-team="T1"').otherwise("")
        return _cat("<li", team, '><a href="', _href(i), '"><h4>', _title(i), "</h4></a>", time, place, "<span>Department - Ops | Site</span></li>")

    return pages.job_cards(listing(t, card), rules.JOB_ITEMS).select(*OUT)


@query("X4_feed_items", f"""
with {CARD_SQL} select page_id, case when page_id % 2 = 0 then url else replace(url, 'https://site.test/list/rel', 'https://site.test/rel') end as source_url,
  title, published, summary from cards where published is not null and i < 3""")
def x4(t: Inputs):
    def url(i):
        key = _s(F.col("o_orderkey"))
        return F.when(i % 3 == 0, _cat("https://site.test/d/", key, "/", _s(i))).when(i % 3 == 1, _href(i)).otherwise(_cat("https://site.test/rel/", key, "-", _s(i)))

    def date(i):
        return F.when(i % 3 == 0, _cat("2024-03-0", _s(i + 1))).when(i % 3 == 1, _cat("March ", _s(i + 1), ", 2024")).otherwise("")

    def rss(i):
        return _cat("<item><title><![CDATA[", _title(i), "]]></title><link>", url(i), "</link><pubDate>", date(i), "</pubDate><description>",
                    F.lit("Sum "), F.col("o_orderstatus"), "  &lt;b&gt;", _s(i), "&lt;/b&gt;</description></item>")

    def atom(i):
        return _cat('<entry><title type="text">', _title(i), '</title><link rel="x" href="', url(i), '"/><updated>', date(i), "</updated><content>", _summary(i), "</content></entry>")

    steps = F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int"))
    atom_feed = F.col("o_orderkey") % 2 == 1
    xml = F.concat(F.lit("<feed>"), F.array_join(F.when(atom_feed, F.transform(steps, atom)).otherwise(F.transform(steps, rss)), ""), F.lit("</feed>"))
    f = t.orders.select(F.col("o_orderkey").alias("page_id"), F.when(atom_feed, "atom").otherwise("rss").alias("transport"), xml.alias("xml"))
    # the fourth card has a date too, so a limit of two cuts it off
    return feeds.feed_items(f, max_items=2).select(*OUT)


@query("X20_search_response", """
select o_orderkey as page_id, i + 1 as rank, concat('https://a.test/', i) as url, concat('T ', o_orderkey) as title, concat('Sum ', o_orderstatus) as snippet,
   case when i = 0 then '2 days ago' else '2024-01-01' end as published from orders, unnest(range(3)) t(i) where i < 2""")
def x20(t: Inputs):
    def result(i):
        return F.struct(
            F.when(i < 2, _cat("https://a.test/", _s(i))).alias("url"), _cat("T ", _s(F.col("o_orderkey"))).alias("title"),
            _cat("<b>Sum</b>  ", F.col("o_orderstatus")).alias("description"), F.when(i == 0, "2 days ago").alias("age"),
            F.lit("2024-01-01").alias("page_age"),
        )

    body = F.to_json(F.struct(F.struct(F.transform(F.sequence(F.lit(0), F.lit(2)), result).alias("results")).alias("web")))
    r = t.orders.select(F.col("o_orderkey").alias("page_id"), body.alias("body"))
    return feeds.search_response_hits(r).select("page_id", F.col("rank").cast("long").alias("rank"), "url", "title", "snippet", "published")


@query("X11_search_results", """
with s as (select o_custkey as site, o_orderkey as q, i, case i when 0 then concat('https://news.test/a/', o_orderkey % 3) when 1 then concat('https://sub.news.test/b?x=', o_orderkey % 2)
      end as url, concat('R ', i, ' & ', o_orderpriority) as title, case i when 0 then concat('snip ', o_orderstatus) else '' end as snippet
   from orders, unnest(range(3)) t(i) where i < 2),
f as (select *, row_number() over (partition by site, url order by q, i) as rn from s),
r as (select *, row_number() over (partition by site order by q, i) as pos from f where rn = 1)
select site, url as source_url, title, snippet from r where pos <= 4""")
def x11(t: Inputs):
    key = F.col("o_orderkey")

    def result(i):
        wrapped = _cat("//duckduckgo.com/l/?uddg=", F.url_encode(_cat("https://www.news.test/a/", _s(key % 3), "?utm_source=z")), "&amp;rut=1")
        link = F.when(i == 0, wrapped).when(i == 1, _cat("https://sub.news.test/b?x=", _s(key % 2))).otherwise("https://notnews.test/c")
        snip = F.when(i == 0, _cat('<a class="result__snippet" href="#">snip <b>', F.col("o_orderstatus"), "</b></a>")).otherwise("<div>x</div>")
        return _cat('<a rel="nofollow" class="x result__a" href="', link, '">R ', _s(i), " &amp; ", F.col("o_orderpriority"), "</a>", snip)

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), result), "<br>")
    p = t.orders.select(F.col("o_custkey").alias("site"), key.alias("query_rank"), F.lit("News.test").alias("domain"), text.alias("html"))
    found = pages.search_results(p)
    return pages.site_results(found, 4).select("site", "source_url", "title", "snippet")


@query("X2_csv_names", """select concat(p_name, ' "', p_brand, '", ', p_partkey) as name_en from part""")
def x2(t: Inputs):
    path = new_state_dir(t.spark, "names")
    line = F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", '), "p_partkey")
    t.part.select(line.alias("category")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return read_names(t.spark, path).select("name_en")


@query("P13_published_text", f"with {CARD_SQL} select page_id, i, published from cards")
def p13(t: Inputs):
    cards = t.orders.select("o_orderkey", "o_orderpriority", F.explode(F.sequence(F.lit(0), (F.col("o_orderkey") % 4).cast("int"))).alias("i"))
    return cards.select(
        F.col("o_orderkey").alias("page_id"), F.col("i").cast("long").alias("i"), h.published_text(_date(F.col("i"))).alias("published")
    )


@query("P14_tolerant_timestamp", """
select o_orderkey, date_trunc('day', o_orderdate) as iso, date_trunc('day', o_orderdate) + interval 10 hour as mail, date_trunc('day', o_orderdate) as prose,
   null::timestamp as bad, o_orderdate as fallback from orders""")
def p14(t: Inputs):
    d = F.col("o_orderdate")
    mail = F.concat(F.date_format(d, "EEE, dd MMM yyyy"), F.lit(" 12:00:00 +0200"))
    return t.orders.select(
        "o_orderkey", parse_timestamp(F.date_format(d, "yyyy-MM-dd")).alias("iso"), parse_timestamp(mail).alias("mail"),
        parse_timestamp(F.date_format(d, "MMMM d, yyyy")).alias("prose"),
        parse_timestamp(F.col("o_orderpriority")).alias("bad"), parse_or(F.col("o_orderpriority"), d.cast("timestamp")).alias("fallback"),
    )


@query("P40_promo_and_title", """
select page_id, regexp_matches(lower(html), '\\b(sponsored|promoted|promotional|advertorial|advertisement|newsletter|webinar|promo)\\b') as promo,
   trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title from pages""")
def p40(t: Inputs):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    tagged = F.concat(title, F.lit("  tag: Promo list"))
    return t.pages.select(
        "page_id", h.is_promotional(F.col("html"), F.lit("t")).alias("promo"), h.clean_title(tagged).alias("title")
    )


@query("P41_label_value", "select p_partkey, p_name as name, p_type as kind from part")
def p41(t: Inputs):
    text = F.concat(F.lit("x • location: "), "p_name", F.lit(" | Type - "), "p_type", F.lit("\nend"))
    return t.part.select("p_partkey", h.label_value(text, "Location").alias("name"), h.label_value(text, "Type").alias("kind"))


@query("P44_clean_reasons", """
select event_id, case when event_type = 'click' then 2 when event_type = 'view' then 1 else 0 end as n, case when event_type in ('click', 'view') then concat('t', user_id) end as first_title from events""")
def p44(t: Inputs):
    good = F.concat(F.lit('{"kind":"media","titleEn":"t'), "user_id", F.lit('","detailEn":"d"}'))
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("["), good, F.lit(","), good, F.lit("]")))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), good, F.lit(',{"titleEn":"only"}]')))
        .when(F.col("event_type") == "error", "not json").otherwise('{"titleEn":"no list"}')
    )
    r = t.events.select("event_id", pages.clean_reasons(text).alias("r"))
    return r.select("event_id", F.size("r").alias("n"), F.try_element_at("r", F.lit(1))["titleEn"].alias("first_title"))
