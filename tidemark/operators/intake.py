"""Normalising and deduplicating what was fetched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_timestamp
from tidemark.functions.bind import bind
from tidemark.functions.policy import is_discovery
from tidemark.functions.text import trim_all
from tidemark.functions.urls import canonical
from tidemark.operators.joins import dealt_join
from tidemark.operators.ranking import first_per_key, last_value_first_position
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Intake:
    """Kept items, and the sources which failed on a bad date."""

    items: DataFrame
    failed_sources: DataFrame


def normalise_fetch(raw: DataFrame) -> Intake:
    """Key by canonical URL, last value inside a source, first source across sources.

    ``raw``: idx (position in the run), source_ord, source_catalog_id, source_url, title, summary,
    published (text), other columns kept. A date which cannot be read fails its whole source before
    any of its keys counts as seen. The URL is stored as fetched, canonical only for discovery.
    """
    keyed = bind(raw, url_key=canonical(F.col("source_url")))
    one = last_value_first_position(keyed, ["source_ord", "url_key"], "idx")
    # kept, so that finding the failed sources and using the rest is one pass over the fetch
    parsed = cut_lineage(one.withColumn("published_at", parse_timestamp(F.col("published"))))
    failed = parsed.filter(F.col("published_at").isNull()).select("source_ord").distinct()
    # few sources hold all rows: they are dealt over parts
    good = dealt_join(parsed, failed, "source_ord", ["url_key"], "left_anti")
    kept = first_per_key(good, ["url_key"], [F.col("source_ord"), F.col("first_position")])
    stored = F.when(is_discovery(F.col("source_catalog_id")), F.col("url_key")).otherwise(F.col("source_url"))
    items = kept.withColumns(
        {"source_url": stored, "title": trim_all(F.col("title")), "summary": trim_all(F.col("summary"))}
    )
    return Intake(items=items, failed_sources=failed)
