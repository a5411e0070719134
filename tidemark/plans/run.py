"""The whole ingest: fetched pages to stored rows, committed as one run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators.commits import commit, committed
from tidemark.operators.intake import normalise_fetch
from tidemark.operators.matching import select_candidates
from tidemark.operators.state import upsert, upsert_decisions
from tidemark.plans import classify as cl
from tidemark.plans.ingest import Persisted, persist_rows
from tidemark.session import cut_lineage
from tidemark.sources import pages as extract

#: Extractor of each transport of a source.
EXTRACTORS = {
    "articles": extract.article_cards, "classed": extract.classed_cards, "headings": extract.heading_cards,
    "anchors": extract.anchor_cards, "json": extract.json_items,
}
SOURCE_COLUMNS = ("source_ord", "source_catalog_id", "source_type", "source_class", "mapping_mode", "source_role_slug")


def extracted(pages: DataFrame) -> DataFrame:
    """Items of all pages with ``idx``, their position in the run: page, then place on it.

    ``pages``: page_id, transport, base_url, html and the columns of their source. Every page goes through the extractor
    of its transport; an unknown transport is an error.
    """
    unknown = F.raise_error(F.concat(F.lit("Unknown transport: "), F.coalesce("transport", F.lit("none")))).cast("boolean")
    checked = pages.filter(F.when(F.col("transport").isin(*EXTRACTORS), F.lit(True)).otherwise(unknown))
    parts = [
        run(checked.filter(F.col("transport") == name)).select(
            F.struct("page_id", "place").alias("idx"), *SOURCE_COLUMNS, "source_url", "title", "summary", "published")
        for name, run in EXTRACTORS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def item_key() -> F.Column:
    """Id of an item: what is stored under one source and URL is one item."""
    return F.sha2(F.concat_ws("\x1f", "source_catalog_id", "source_url"), 256)


def stored_for_probe(tables: Persisted) -> DataFrame:
    """Stored items with their decision and inference, as the cache probe reads them."""
    decisions = tables.decisions.select("item_id", "decision_status", "reason")
    inferences = tables.inferences.select(
        "item_id", "inferred_slug", "provider", "model", "summary_en", "summary_zh", "impact", "relevance", "signal_weight", "raw_json")
    return tables.items.select("item_id", "source_catalog_id", "source_url", "input_hash", "prompt_version", "model_name").join(
        decisions, "item_id", "left").join(inferences, "item_id", "left").withColumns({
            "has_decision": F.col("decision_status").isNotNull(), "has_inference": F.col("provider").isNotNull()}).drop("item_id")


def ingest(
    pages: DataFrame, lex: DataFrame, roles: DataFrame, state: DataFrame, stored: Persisted | None, model: cl.BatchModel,
    models: Sequence[str] = (rules.DEFAULT_MODEL,), noise: Sequence[str] = rules.BROAD_NOISE_TERMS, workflow: Sequence[str] = rules.WORKFLOW_TERMS,
) -> tuple[Persisted, DataFrame]:
    """The rows one run stores, and the classified items.

    Pages are read apart, normalised, deduplicated and matched; items with a usable stored classification keep it, the others
    go to the model once.
    """
    kept = normalise_fetch(extracted(pages)).items
    items = cut_lineage(kept.withColumns({
        "item_id": item_key(), "hints": F.array().cast("array<string>"), "hint_text": F.lit("")}))
    candidates = select_candidates(items, lex, noise=noise, workflow=workflow)
    context = cl.with_input_hashes(cl.with_candidates(items, candidates, lex, roles), models)
    if stored is None:
        nothing = F.lit(None).cast(
            "struct<input_hash: string, prompt_version: string, model_name: string, decision_status: string, reason: string, "
            "inferred_slug: string, provider: string, model: string, summary_en: string, summary_zh: string, impact: string, "
            "relevance: string, signal_weight: double, raw_json: string, has_decision: boolean, has_inference: boolean>")
        probed = context.withColumns({"cached": nothing, "cache_hit": F.lit(False)})
    else:
        probed = cl.probe_cache(context, stored_for_probe(stored), models)
    classified = cut_lineage(cl.classify(probed, model, workflow=workflow))
    return persist_rows(classified, state), classified


# ---- commit ----------------------------------------------------------------------------------
TABLES = tuple(f.name for f in fields(Persisted))
KEYS = {"items": ["item_id"], "inferences": ["item_id"], "signals": ["slug", "source_url"]}


def merged(rows: Persisted, last: Persisted | None, now: datetime) -> dict[str, DataFrame]:
    """The four tables after a run: its rows replace stored ones of their keys, reviews of decisions stay."""
    decisions = rows.decisions.withColumn("reviewed_at", F.lit(now).cast("timestamp"))
    if last is None:
        return {"items": rows.items, "decisions": decisions, "inferences": rows.inferences, "signals": rows.signals}
    # a review stays unless the source approves by itself
    stated = F.when(F.col("review_status") == "APPROVED", F.col("review_status"))
    after = {n: upsert(getattr(last, n), getattr(rows, n), k).select(getattr(rows, n).columns) for n, k in KEYS.items()}
    return after | {"decisions": upsert_decisions(last.decisions, rows.decisions.withColumn("review_status", stated), now).select(decisions.columns)}


def run_once(spark: SparkSession, root: str, run: int, inputs: Mapping, now: datetime) -> tuple[Persisted, DataFrame]:
    """One numbered run over fetched pages: its stored tables after the commit, and the items it classified."""
    tables = committed(spark, root, TABLES, run)
    before = tables and Persisted(**tables)
    rows, classified = ingest(stored=before, **inputs)
    return Persisted(**commit(spark, root, run, merged(rows, before, now), now)), classified
