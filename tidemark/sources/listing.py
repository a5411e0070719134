"""Ranking of extracted items."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.dates import parse_timestamp
from tidemark.functions.text import ascii_bounds
from tidemark.operators.ranking import ranked, top_k


def rule_score(haystack: Column, table: Iterable[tuple[str, int]] = rules.LISTING_RANK_RULES) -> Column:
    """Sum of the weights of the patterns found."""
    score = F.lit(0)
    for pattern, weight in table:
        score = score + F.when(F.rlike(haystack, F.lit(ascii_bounds(pattern))), weight).otherwise(0)
    return score


def by_relevance(
    items: DataFrame, keys: Sequence[str], table: Iterable[tuple[str, int]] = rules.LISTING_RANK_RULES, limit: int | None = None,
) -> DataFrame:
    """Adds ``score`` and ``relevance_rank`` within a page (``keys``): highest score first, then newest.

    With a limit only the first rows of each page stay, as a source's setting asks.
    """
    haystack = F.lower(F.concat("title", F.lit(" "), "summary"))
    scored = items.withColumn("score", rule_score(haystack, table))
    order = [F.col("score").desc(), parse_timestamp(F.col("published_at")).desc_nulls_last(), F.col("source_url").asc()]
    if limit is None:
        return ranked(scored, keys, order, "relevance_rank")
    return top_k(scored, keys, order, limit, rank="relevance_rank")
