"""Weekly and monthly score history, and the structural score of a role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.profile import structural_result
from tidemark.functions.rates import round_half_up


def local_time(ts: Column, zone: str = rules.TREND_TIME_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def week_label(ts: Column) -> Column:
    return F.date_format(F.date_trunc("week", local_time(ts)), "yyyy-MM-dd")


def month_label(ts: Column) -> Column:
    return F.date_format(local_time(ts), "yyyy-MM")


def bucket_labels(ts: Column) -> Column:
    """Both buckets of a moment, so that one pass over the rows serves week and month."""
    return F.array(
        F.struct(F.lit("week").alias("grain"), week_label(ts).alias("bucket")),
        F.struct(F.lit("month").alias("grain"), month_label(ts).alias("bucket")),
    )


def bucket_spans(ts: Column, zone: str = rules.TREND_TIME_ZONE) -> Column:
    """Both buckets of a moment with the moment each ends."""

    def end(unit: str, step: str) -> Column:
        return F.to_utc_timestamp(F.date_trunc(unit, local_time(ts, zone)) + F.expr(step), zone)

    return F.array(
        F.struct(F.lit("week").alias("grain"), week_label(ts).alias("bucket"), end("week", "interval 7 days").alias("bucket_end")),
        F.struct(F.lit("month").alias("grain"), month_label(ts).alias("bucket"), end("month", "interval 1 month").alias("bucket_end")),
    )


def trend(snapshots: DataFrame, keys: tuple[str, ...] = ("role_id",)) -> DataFrame:
    """Rounded mean and number of known rates per key, grain and bucket.

    Sum and count per day-sized bucket combine on the map side, so a role with very many snapshots
    costs one row per bucket and task in the shuffle.
    """
    known = snapshots.filter(F.col("rate").isNotNull())
    return (
        known.select(*keys, "rate", F.inline(bucket_labels(F.col("snapshot_at"))))
        .groupBy(*keys, "grain", "bucket")
        .agg(
            round_half_up(F.sum(F.col("rate").cast("long")).cast("double") / F.count("rate")).alias("average_rate"),
            F.count("rate").alias("points"),
        )
    )


def structural_scores(roles: DataFrame, signals: DataFrame) -> DataFrame:
    """Status, level and trend per role from seven scores and the strengths of its signals."""
    boosts = signals.groupBy("slug").agg(
        F.sum(F.when(F.col("strength") == "HIGH", 2).when(F.col("strength") == "MEDIUM", 1).otherwise(0))
        .alias("boost"),
        F.count("*").alias("signals"),
    )
    base = (
        F.col("s_repetition") + F.col("s_rules") + F.col("s_transformation") + F.col("s_workflow")
        - F.col("s_interpersonal") - F.col("s_physical") - F.col("s_ambiguity")
    )
    joined = roles.join(boosts, "slug", "left").select(
        "slug", base.alias("base"), F.coalesce("boost", F.lit(0)).alias("boost"),
        F.coalesce("signals", F.lit(0)).alias("signals"),
    )
    return joined.select("slug", *[
        c.alias(n)
        for n, c in structural_result(F.col("base"), F.col("boost"), F.col("signals")).items()
    ])
