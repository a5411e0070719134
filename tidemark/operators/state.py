"""Keyed state: upserts, appends, replacement of children, versions and flags."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import trim_all


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """The next version of a keyed table: new rows replace old ones whole.

    Fields in ``keep_if_null`` keep the old value where the new one is NULL. Both sides hold a key
    once; reduce a batch with repeated keys first. One co-partitioned join, no driver work.
    """
    fields = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*fields).alias("_old"))
    n = new.select(*keys, F.struct(*fields).alias("_new"))

    def pick(c: str) -> Column:
        fresh, stale = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        if c in keep_if_null:
            return F.coalesce(fresh, stale).alias(c)
        return F.when(F.col("_new").isNotNull(), fresh).otherwise(stale).alias(c)

    return o.join(n, list(keys), "full").select(*keys, *[pick(c) for c in fields])


def replace_children(old: DataFrame, parents: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All children of the given parents are dropped, the new ones put in their place."""
    touched = parents.select(*keys).distinct()
    return old.join(touched, list(keys), "left_anti").unionByName(children.select(old.columns))


def upsert_decisions(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """Decisions by item; a review status stays unless the new row states one.

    ``new.review_status`` is NULL where nothing is stated.
    """
    fields = [c for c in old.columns if c not in ("item_id", "review_status", "reviewed_at")]
    o = old.select("item_id", F.struct(*old.columns).alias("_o"))
    n = new.select("item_id", F.struct(*new.columns).alias("_n"))
    stated = F.col("_n.review_status")
    status = F.coalesce(stated, F.col("_o.review_status"), F.lit("PENDING"))
    moment = F.lit(now).cast(old.schema["reviewed_at"].dataType)
    reviewed = (
        F.when(F.col("_n").isNull(), F.col("_o.reviewed_at"))
        .when(status == "PENDING", None)
        .when(stated.isNotNull(), moment)
        .otherwise(F.coalesce(F.col("_o.reviewed_at"), moment))
    )
    return o.join(n, "item_id", "full").select(
        "item_id",
        *[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in fields],
        status.alias("review_status"),
        reviewed.alias("reviewed_at"),
    )


def apply_reviews(decisions: DataFrame, actions: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Decisions after the review actions, and the actions refused with the reason.

    An approval needs a role and an accepted decision; a rejection always applies. ``actions``:
    item_id, action.
    """
    known = actions.join(
        decisions.select("item_id", "decision_slug", "decision_status"), "item_id", "left"
    )
    approvable = F.col("decision_slug").isNotNull() & (F.col("decision_status") == "ACCEPTED")
    problem = F.when(F.col("decision_status").isNull(), "unknown decision").when(
        (F.col("action") == "approve") & ~F.coalesce(approvable, F.lit(False)), "not reviewable yet"
    )
    judged = known.withColumn("problem", problem)
    applied = judged.filter(F.col("problem").isNull()).select(
        "item_id", F.when(F.col("action") == "approve", "APPROVED").otherwise("REJECTED").alias("_status")
    )
    moment = F.lit(now).cast(decisions.schema["reviewed_at"].dataType)
    after = (
        decisions.join(applied, "item_id", "left")
        .withColumns(
            {
                "review_status": F.coalesce("_status", "review_status"),
                "reviewed_at": F.when(F.col("_status").isNotNull(), moment).otherwise(F.col("reviewed_at")),
            }
        )
        .drop("_status")
    )
    return after, judged.filter(F.col("problem").isNotNull()).select("item_id", "action", "problem")


def probe_runs(probes: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """Probes with the run of the same hash where that has not expired; ``fresh`` says so."""
    live = runs.filter(F.col("expires_at") > F.lit(now)).select("query_hash", "run_id")
    return probes.join(live, "query_hash", "left").withColumn("fresh", F.col("run_id").isNotNull())


def refresh_targets(results: DataFrame) -> DataFrame:
    """Distinct roles named by a discovery result: plain slugs, and the first usable field of structs.

    ``results``: affected_slugs array<string>, affected_roles array<struct<role_slug, slug>>,
    signals array<struct<role_slug, assigned_slug>>.
    """

    def usable(c: Column) -> Column:
        t = trim_all(c)
        return F.when(F.length(t) > 0, t)

    named = F.concat(
        F.transform("affected_slugs", usable),
        F.transform("affected_roles", lambda r: F.coalesce(usable(r["role_slug"]), usable(r["slug"]))),
        F.transform("signals", lambda s: F.coalesce(usable(s["role_slug"]), usable(s["assigned_slug"]))),
    )
    return results.select(F.explode(F.filter(named, lambda s: s.isNotNull())).alias("slug")).distinct()


def refresh_snapshots(before: DataFrame, after: DataFrame, outcome: DataFrame, moment: datetime) -> DataFrame:
    """Snapshot rows of a full refresh.

    ``before`` and ``after``: slug, replacement_rate, risk_level, rating_status, last_rated_at,
    risk_cached_at. ``outcome``: slug, targets (count), own_failed. Roles whose own refresh failed
    give none; without targets the retained state is written and counts as not recomputed.
    """
    fields = ("replacement_rate", "risk_level", "rating_status", "last_rated_at", "risk_cached_at")
    b = before.select("slug", *[F.col(c).alias(f"b_{c}") for c in fields])
    a = after.select("slug", *[F.col(c).alias(f"a_{c}") for c in fields])
    joined = outcome.filter(~F.col("own_failed")).join(b, "slug", "left").join(a, "slug", "left")
    none = F.col("targets") == 0

    def value(c: str) -> Column:
        return F.coalesce(F.when(~none, F.col(f"a_{c}")), F.col(f"b_{c}"))

    changed = ~value("last_rated_at").eqNullSafe(F.col("b_last_rated_at")) | ~value("risk_cached_at").eqNullSafe(
        F.col("b_risk_cached_at")
    )
    return joined.select(
        "slug", F.lit(moment).alias("snapshot_at"),
        *[value(c).alias(c) for c in fields[:3]],
        (~none & changed).alias("was_recomputed"),
        F.lit("full_refresh").alias("source"),
    )


def refresh_totals(results: DataFrame) -> DataFrame:
    """Roles, successes, failures, roles with hits, refreshed roles; one row."""
    return results.agg(
        F.count("*").alias("total_roles"),
        F.count_if(~F.col("failed")).alias("successes"),
        F.count_if(F.col("failed")).alias("failures"),
        F.count_if(F.col("timeline_hits") > 0).alias("roles_with_hits"),
        F.sum("refreshed").alias("refreshed"),
    )


def append_snapshots(batch: DataFrame, path: str) -> None:
    """Append to a history laid out by day; (role, moment) pairs which exist already are left out.

    Only the days of the batch are read back, by partition pruning.
    """
    spark = batch.sparkSession
    dated = batch.dropDuplicates(["role_id", "snapshot_at"]).withColumn(
        "snapshot_date", F.to_date("snapshot_at")
    )
    if path_exists(spark, path):
        stored = spark.read.parquet(path).select("role_id", "snapshot_at", "snapshot_date")
        dated = dated.join(stored, ["role_id", "snapshot_at", "snapshot_date"], "left_anti")
    dated.write.mode("append").partitionBy("snapshot_date").parquet(path)


def path_exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p)
