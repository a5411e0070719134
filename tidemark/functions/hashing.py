"""Content hashes which are stable between runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import collapse_space


def stable_hash(*columns: Column) -> Column:
    """SHA-256 over the columns as JSON, NULL fields written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def collapsed_texts(title: Column, summary: Column, hints: Column) -> tuple[Column, Column, Column]:
    return collapse_space(title), collapse_space(summary), F.transform(hints, collapse_space)


def item_hash(
    catalog_id: Column, url: Column, source_type: Column, title: Column, summary: Column,
    hints: Column, candidates: Column, prompt_version: Column, model: Column, collapsed: bool = False,
) -> Column:
    """Hash of an item as a model sees it; ``collapsed`` says that its texts went through ``collapsed_texts``."""
    if not collapsed:
        title, summary, hints = collapsed_texts(title, summary, hints)
    return stable_hash(
        catalog_id.alias("catalog_id"),
        url.alias("url"),
        source_type.alias("source_type"),
        title.alias("title"),
        summary.alias("summary"),
        hints.alias("hints"),
        candidates.alias("candidates"),
        prompt_version.alias("prompt_version"),
        model.alias("model"),
    )


def query_hash(slug: Column, provider: Column, query: Column) -> Column:
    return stable_hash(
        slug.alias("slug"), provider.alias("provider"), collapse_space(query).alias("query")
    )
