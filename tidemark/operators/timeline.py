"""What belongs to a role in time: timelines, their merge, the readers of the item star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.urls import host, is_public, mentions_example
from tidemark.operators.joins import dealt_join
from tidemark.operators.ranking import last_value_first_position, top_k



def newest() -> list[Column]:
    return [F.col("published_at").desc(), F.col("item_id").asc()]


def memberships(items: DataFrame) -> DataFrame:
    """(item, role) rows: accepted for the role, or inferred for it and accepted for any.

    Decision and inference are one to one with the item, so both conditions read the same row and
    the two roles it may name are unfolded in place.
    """
    slugs = F.array_distinct(F.filter(F.array("decision_slug", "role_slug"), lambda s: s.isNotNull()))
    return items.filter(F.col("decision_status") == "ACCEPTED").select(
        "*", F.explode(slugs).alias("slug")
    )


def timeline_texts() -> dict[str, Column]:
    """Texts of a timeline row with their fallbacks."""
    return {
        "shown_summary": F.coalesce("inference_summary_en", "summary_en"),
        "rationale": F.coalesce("reason", "inference_summary_en", "summary_en"),
        "source_host": host(F.col("source_url")),
    }


def timelines(items: DataFrame, k: int = rules.TIMELINE_SIZE) -> DataFrame:
    """Newest k rows per role; placeholder hosts by substring before the cut, by host after it."""
    rows = memberships(items.filter(~mentions_example(F.col("source_url"))))
    return top_k(rows, ["slug"], newest(), k, rank="timeline_rank").filter(is_public(F.col("source_url")))


def since_boundaries(timeline: DataFrame, boundaries: DataFrame, k: int, measure: DataFrame | None = None) -> DataFrame:
    """For each boundary row the newest k timeline rows of its role after its moment.

    Rows after a moment are a prefix of the newest-first order, so the k newest rows of each role
    hold every answer and the join sees at most k rows per role. ``boundaries``: slug, boundary; ``measure``: a cheaper
    frame with their shares of roles.
    """
    recent = timeline.filter(F.col("timeline_rank") <= k)
    return dealt_join(boundaries, recent, "slug", boundaries.columns, measure=measure).filter(F.col("published_at") > F.col("boundary"))


def latest_signals(signals: DataFrame, keys: tuple[str, ...] = ("slug",)) -> DataFrame:
    """Newest signal per role as a struct column ``latest``."""
    fields = [c for c in signals.columns if c not in keys]
    return signals.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct("published_at", "item_id")).alias("latest")
    )


MERGED = ("row_id", "title", "label", "summary", "published_at")


def merged_timeline(
    signals: DataFrame, items: DataFrame, discovery: DataFrame, k: int = rules.TIMELINE_SIZE
) -> DataFrame:
    """Signals overlaid by items of the same URL, then discovery rows with new URLs; newest k.

    All three: slug, url, row_id, title, label, summary, published_at; each is cut to its newest k
    first, so the merge works on bounded rows per role.
    """
    order = [F.col("published_at").desc(), F.col("row_id").asc()]

    def cut(df: DataFrame) -> DataFrame:
        return top_k(df, ["slug"], order, k, rank="_position")

    def one_per_url(df: DataFrame) -> DataFrame:
        return last_value_first_position(df, ["slug", "url"], "_position").drop("first_position", "_position")

    first = one_per_url(cut(signals).filter(is_public(F.col("url"))))
    second = one_per_url(cut(items).filter(is_public(F.col("url"))))
    a = first.select("slug", "url", *[F.col(c).alias(f"a_{c}") for c in MERGED])
    b = second.select("slug", "url", *[F.col(c).alias(f"b_{c}") for c in MERGED])
    both = a.join(b, ["slug", "url"], "full").select(
        "slug", "url", *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in MERGED]
    )
    kept = top_k(both, ["slug"], order, k)
    extra = one_per_url(cut(discovery)).join(kept.select("slug", "url"), ["slug", "url"], "left_anti")
    return top_k(kept.unionByName(extra.select(kept.columns)), ["slug"], order, k, rank="timeline_rank")


def star(items: DataFrame, roles: DataFrame) -> DataFrame:
    """Item with decision and inference, role attached; unknown roles give NULL names."""
    names = roles.select(
        F.col("slug").alias("decision_slug"), F.lit(True).alias("role_known"),
        F.col("name_en").alias("role_name_en"), F.col("name_zh").alias("role_name_zh"),
    )
    return dealt_join(items, names, "decision_slug", ["item_id"], "left")


def _newest_rows(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*newest()).limit(n)


def review_queue(rows: DataFrame, n: int = 20) -> DataFrame:
    return _newest_rows(
        rows.filter(
            (F.col("review_status") == "PENDING") & F.col("role_known") & (F.col("decision_status") == "ACCEPTED")
        ), n,
    )


def inference_diagnostics(rows: DataFrame, n: int = 20) -> DataFrame:
    return _newest_rows(rows.filter(F.col("inference_summary_en").isNotNull()), n)


def recent_approved(rows: DataFrame, n: int = 6) -> DataFrame:
    return _newest_rows(
        rows.filter(
            (F.col("decision_status") == "ACCEPTED")
            & ~mentions_example(F.col("source_url"))
            & (F.col("role_known") | F.col("inference_summary_en").isNotNull())
        ), n,
    )
