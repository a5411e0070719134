"""Feeds and saved search responses as item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bind import unfold
from tidemark.functions.html import decode, drop_tags
from tidemark.functions.text import collapse_space, trim_all


def _tag(item: Column, tag: str) -> Column:
    """Decoded body of a feed tag, NULL where the tag is missing."""
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    body = F.regexp_extract(item, pattern, 1)
    bare = F.replace(F.replace(body, F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    return F.when(F.rlike(item, F.lit(pattern)), decode(trim_all(bare), nbsp=False))


def _atom_link(item: Column) -> Column:
    pattern = r'(?i)<link\b[^>]*href="([^"]+)"'
    href = decode(trim_all(F.regexp_extract(item, pattern, 1)), nbsp=False)
    return F.when(F.rlike(item, F.lit(pattern)), href).otherwise(_tag(item, "link"))


def _non_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def feed_items(feeds: DataFrame, max_items: int | None = None) -> DataFrame:
    """Items of RSS and Atom texts with link, title and date: all, or the first ``max_items`` of each text.

    ``feeds``: xml, transport ('rss' or 'atom'), and identifying columns which are kept. All of a
    feed's items are read inside its own row, so nothing is shuffled.
    """
    atom = F.col("transport") == "atom"
    blocks = F.when(
        atom, F.regexp_extract_all("xml", F.lit(r"(?is)<entry\b.*?</entry>"), F.lit(0))
    ).otherwise(F.regexp_extract_all("xml", F.lit(r"(?is)<item\b.*?</item>"), F.lit(0)))

    def item(x: Column) -> Column:
        summary = F.coalesce(
            _tag(x, "description"), _tag(x, "summary"), _tag(x, "content:encoded"),
            _non_empty(_tag(x, "content")), _non_empty(_tag(x, "atom:content")), F.lit(""),
        )
        return F.struct(
            F.when(atom, _atom_link(x)).otherwise(_tag(x, "link")).alias("source_url"),
            _tag(x, "title").alias("title"),
            F.coalesce(_tag(x, "pubDate"), _tag(x, "published"), _tag(x, "updated")).alias("published"),
            drop_tags(summary).alias("summary"),
        )

    kept = F.filter(
        F.transform(blocks, item),
        lambda i: (F.length(i["source_url"]) > 0) & (F.length(i["title"]) > 0) & (F.length(i["published"]) > 0),
    )
    others = [c for c in feeds.columns if c not in ("xml", "transport")]
    return unfold(feeds, kept if max_items is None else F.slice(kept, 1, max_items), *others)


SEARCH_SCHEMA = (
    "web struct<results: array<struct<url: string, title: string, description: string, age: string, page_age: string>>>"
)


def search_response_hits(responses: DataFrame, body: str = "body") -> DataFrame:
    """Hits of saved search responses: URL and title needed, tags dropped from the snippet."""
    others = [c for c in responses.columns if c != body]
    results = F.from_json(body, SEARCH_SCHEMA)["web"]["results"]
    rows = responses.select(*others, F.posexplode(results).alias("_pos", "_r"))
    r = F.col("_r")
    return rows.filter((F.length(r["url"]) > 0) & (F.length(r["title"]) > 0)).select(
        *others, r["url"].alias("url"), r["title"].alias("title"),
        collapse_space(F.regexp_replace(F.coalesce(r["description"], F.lit("")), "<[^>]+>", "")).alias("snippet"),
        F.coalesce(r["age"], r["page_age"]).alias("published"), (F.col("_pos") + 1).alias("rank"),
    )
