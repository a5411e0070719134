"""One nested row per role: state, timeline, related roles, trend and resolved texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.presentation import resolved_summary


def role_detail(state: DataFrame, timeline: DataFrame, related: DataFrame, trend: DataFrame) -> DataFrame:
    """Bounded lists per role: ten timeline rows, six related roles, one trend point per bucket.

    ``state``: slug and texts; ``timeline`` (the merged one): slug, timeline_rank, url, title, published_at;
    ``related``: base_slug, related_rank, related_slug; ``trend``: slug, grain, bucket, average_rate,
    points.
    """
    items = timeline.groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("timeline_rank", "url", "title", "published_at"))).alias("timeline"),
        F.max("published_at").alias("latest_published_at"),
    )
    near = related.groupBy(F.col("base_slug").alias("slug")).agg(
        F.array_sort(F.collect_list(F.struct("related_rank", "related_slug"))).alias("related")
    )
    points = trend.groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("grain", "bucket", "average_rate", "points"))).alias("trend")
    )
    joined = state.join(items, "slug", "left").join(near, "slug", "left").join(points, "slug", "left")
    count = F.coalesce(F.size("timeline"), F.lit(0))
    counted = joined.withColumn("timeline_count", F.when(F.col("timeline").isNull(), 0).otherwise(count))
    return counted.withColumns(
        {
            f"risk_summary_{loc}": resolved_summary(F.col(f"risk_summary_{loc}"), F.col("timeline_count"), loc)
            for loc in ("en", "zh")
        }
    )
