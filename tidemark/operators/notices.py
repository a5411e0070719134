"""Subscriptions, due notifications and what became of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.rates import delta, direction
from tidemark.functions.text import trim_lower
from tidemark.operators.joins import dealt_join
from tidemark.operators.ranking import top_k
from tidemark.operators.timeline import latest_signals, since_boundaries

_SECOND = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def digest_due(last_digest: Column, oldest: Column, now: datetime) -> Column:
    """A week or more since the last digest, or since the oldest subscription before any digest."""
    basis = micros(F.coalesce(last_digest, oldest))
    due = micros(F.lit(now)) - basis >= rules.DIGEST_INTERVAL_DAYS * 86400 * _SECOND
    return F.coalesce(due, F.lit(False))


def significant_change(
    baseline: Column, current: Column, rated_at: Column, created_at: Column, alerted_at: Column
) -> Column:
    big = F.abs(current - baseline) >= rules.SIGNIFICANT_DELTA
    fresh = micros(rated_at) > micros(F.coalesce(alerted_at, created_at))
    return F.coalesce(big & fresh, F.lit(False))


def tracked_emails(subs: DataFrame) -> DataFrame:
    return subs.select(trim_lower(F.col("email")).alias("email")).distinct()


def digest_basis(subs: DataFrame) -> DataFrame:
    """Last digest, oldest subscription and number of roles per email."""
    return subs.groupBy(trim_lower(F.col("email")).alias("email")).agg(
        F.max("last_digest_at").alias("last_digest_at"),
        F.min("created_at").alias("oldest_created_at"),
        F.count("*").alias("role_count"),
    )


def admit_subscriptions(existing: DataFrame, requests: DataFrame, limit: int = rules.WATCH_LIMIT) -> DataFrame:
    """Outcome of each requested (email, slug): kept already, admitted, or over the limit.

    Requests are served in order of ``requested_at``; a repeated request counts once. Only the first
    ``limit`` new pairs of an email can be admitted, so ranks beyond it need no exact number.
    """
    have = existing.select(trim_lower(F.col("email")).alias("email"), "slug").distinct()
    asked = requests.groupBy(trim_lower(F.col("email")).alias("email"), "slug").agg(
        F.min("requested_at").alias("requested_at")
    )
    known = asked.join(have, ["email", "slug"], "left_semi").withColumn("outcome", F.lit("known"))
    fresh = asked.join(have, ["email", "slug"], "left_anti")
    counts = have.groupBy("email").agg(F.count("*").alias("_have"))
    order = [F.col("requested_at").asc(), F.col("slug").asc()]
    candidates = top_k(fresh, ["email"], order, limit, rank="_rank")
    admitted = (
        candidates.join(counts, "email", "left")
        .filter(F.col("_rank") + F.coalesce("_have", F.lit(0)) <= limit)
        .select("email", "slug", "requested_at", F.lit("admitted").alias("outcome"))
    )
    refused = fresh.join(admitted, ["email", "slug"], "left_anti").withColumn("outcome", F.lit("refused"))
    return known.unionByName(admitted).unionByName(refused)


def without_pending(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """Rows for which no dispatch of the same email, kind and role waits; a NULL role equals NULL."""
    waiting = pending.filter(F.col("status") == "PENDING").select(
        F.col("email").alias("_email"), F.col("kind").alias("_kind"), F.col("slug").alias("_slug")
    )
    return rows.join(
        waiting,
        (F.col("email") == F.col("_email")) & (F.col("kind") == F.col("_kind")) & F.col("slug").eqNullSafe(F.col("_slug")),
        "left_anti",
    )


def watchlists(subs: DataFrame, state: DataFrame, signals: DataFrame) -> DataFrame:
    """Watched roles per email, newest subscription first, with the latest signal of each role.

    The order holds within an email, whose rows lie together.
    """
    latest = latest_signals(signals).select("slug", F.col("latest.summary_en").alias("latest_summary"),
                                            F.col("latest.published_at").alias("latest_published_at"))
    roles = state.drop("email").join(latest, "slug", "left")
    watched = dealt_join(subs.withColumn("email", trim_lower(F.col("email"))), roles, "slug", ["email"], measure=subs)
    return watched.repartition("email").sortWithinPartitions("email", F.col("created_at").desc(), "slug")


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def digest_subject(product: str, count: Column) -> Column:
    return F.concat(
        F.lit(f"{product} weekly digest for "), count.cast("string"), F.lit(" tracked role"), _plural(count)
    )


def alert_subject(product: str, name: Column, rate: Column) -> Column:
    return F.concat(F.lit(f"{product} alert: "), name, F.lit(" moved to "), rate.cast("string"), F.lit("%"))


def _recent(items: DataFrame, keys: list[str]) -> DataFrame:
    """Newest items of each key as one ordered list of at most a few structs."""
    entry = F.struct(
        F.col("timeline_rank"), F.col("title"), F.col("published_at"), F.col("source_url")
    )
    return items.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("recent_items"))


def due_digests(
    subs: DataFrame, state: DataFrame, timeline: DataFrame, pending: DataFrame, now: datetime, product: str
) -> DataFrame:
    """One row per email whose digest is due, with its roles and their two newest items as JSON."""
    own = subs.withColumn("email", trim_lower(F.col("email")))
    basis = digest_basis(subs).filter(digest_due(F.col("last_digest_at"), F.col("oldest_created_at"), now))
    due = without_pending(
        basis.withColumns({"kind": F.lit("WEEKLY_DIGEST"), "slug": F.lit(None).cast("string")}), pending
    ).withColumn("boundary", F.coalesce("last_digest_at", "oldest_created_at"))
    watched = dealt_join(
        own.join(due.select("email", "boundary"), "email"),
        state.select("slug", "name_en", "name_zh", "replacement_rate", "risk_level"), "slug", ["email"], measure=subs,
    )
    lists = _recent(
        since_boundaries(timeline, watched.select("email", "slug", "boundary"), 2, subs), ["email", "slug"]
    )
    role = F.struct(
        F.col("created_at"), F.col("slug"), F.col("name_en"), F.col("replacement_rate"), F.col("risk_level"),
        F.coalesce("recent_items", F.array().cast(lists.schema["recent_items"].dataType)).alias("recent_items"),
    )
    roles = watched.join(lists, ["email", "slug"], "left").groupBy("email").agg(
        F.array_sort(F.collect_list(role)).alias("roles")
    )
    return due.join(roles, "email").select(
        "email", "slug", "kind", "boundary", digest_subject(product, F.size("roles")).alias("subject"),
        F.to_json(F.struct("roles")).alias("payload"),
    )


def due_alerts(
    subs: DataFrame, state: DataFrame, timeline: DataFrame, pending: DataFrame, product: str
) -> DataFrame:
    """One row per email and role whose rate moved far enough since the last alert."""
    joined = dealt_join(
        subs.withColumn("email", trim_lower(F.col("email"))),
        state.select("slug", "name_en", "replacement_rate", "last_rated_at"), "slug", ["email"], measure=subs,
    )
    moved = joined.filter(
        significant_change(
            F.col("last_alert_rate"), F.col("replacement_rate"), F.col("last_rated_at"), F.col("created_at"),
            F.col("last_alert_at"),
        )
    )
    due = without_pending(moved.withColumn("kind", F.lit("SIGNIFICANT_CHANGE")), pending).withColumn(
        "boundary", F.coalesce("last_alert_at", "created_at")
    )
    lists = _recent(since_boundaries(timeline, due.select("email", "slug", "boundary"), 3, subs), ["email", "slug"])
    change = F.struct(
        F.col("last_alert_rate").alias("previous"), F.col("replacement_rate").alias("current"),
        delta(F.col("last_alert_rate"), F.col("replacement_rate")).alias("delta"),
        direction(F.col("last_alert_rate"), F.col("replacement_rate")).alias("direction"),
        F.col("recent_items"),
    )
    return due.join(lists, ["email", "slug"], "left").select(
        "email", "slug", "kind", "boundary",
        alert_subject(product, F.col("name_en"), F.col("replacement_rate")).alias("subject"),
        F.to_json(change).alias("payload"),
    )


def due_notifications(
    subs: DataFrame, state: DataFrame, timeline: DataFrame, pending: DataFrame, now: datetime, product: str
) -> DataFrame:
    return due_digests(subs, state, timeline, pending, now, product).unionByName(
        due_alerts(subs, state, timeline, pending, product)
    )


def next_dispatches(queue: DataFrame, limit: int = 20) -> DataFrame:
    """The waiting ones queued first."""
    return queue.filter(F.col("status") == "PENDING").orderBy("queued_at", "dispatch_id").limit(limit)


def apply_outcomes(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Queue rows with the outcome of their delivery, others unchanged."""
    o = outcomes.select(
        "dispatch_id", F.col("outcome").alias("_outcome"), F.col("sent_at").alias("_sent"), F.col("error").alias("_error")
    )
    joined = queue.join(o, "dispatch_id", "left")
    sent, failed = F.col("_outcome") == "SENT", F.col("_outcome") == "FAILED"
    return joined.withColumns(
        {
            "status": F.coalesce("_outcome", "status"),
            "sent_at": F.when(sent, F.col("_sent")).otherwise(F.col("sent_at")),
            "error": F.when(sent, None).when(failed, F.col("_error")).otherwise(F.col("error")),
        }
    ).drop("_outcome", "_sent", "_error")


def stamp_subscriptions(subs: DataFrame, sent: DataFrame) -> DataFrame:
    """Digest stamp on all rows of an email, alert stamp and rate on one pair.

    ``sent``: email, slug, kind, sent_at, rate of delivered dispatches; the latest of each wins.
    """
    digests = sent.filter(F.col("kind") == "WEEKLY_DIGEST").groupBy("email").agg(
        F.max("sent_at").alias("_digest")
    )
    alerts = sent.filter((F.col("kind") == "SIGNIFICANT_CHANGE") & F.col("slug").isNotNull()).groupBy("email", "slug").agg(
        F.max("sent_at").alias("_alert"), F.max_by("rate", "sent_at").alias("_rate")
    )
    return (
        subs.withColumn("email", trim_lower(F.col("email")))
        .join(digests, "email", "left")
        .join(alerts, ["email", "slug"], "left")
        .withColumns(
            {
                "last_digest_at": F.coalesce("_digest", "last_digest_at"),
                "last_alert_at": F.coalesce("_alert", "last_alert_at"),
                "last_alert_rate": F.when(F.col("_alert").isNotNull(), F.col("_rate")).otherwise(F.col("last_alert_rate")),
            }
        )
        .drop("_digest", "_alert", "_rate")
    )
