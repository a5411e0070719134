"""Joins of a large side with one whose keys have few rows each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in this many is dealt over several parts; so at most this many keys are.
SHARE = 64
#: Keys the frequency sketch reports and tracks; its error is far below a share.
REPORTED, TRACKED = 2 * SHARE, 100 * SHARE


def hot_keys(df: DataFrame, key: str) -> list[tuple]:
    """(key, parts) of keys that hold more than a share of all rows, by a frequency sketch: one slim pass, bounded result."""
    known = F.col(key).isNotNull()
    row = df.agg(F.count_if(known).alias("n"), F.expr(f"approx_top_k(`{key}`, {REPORTED}, {TRACKED})").alias("top")).first()
    rows = [] if row["top"] is None else row["top"]
    return [(r["item"], -(-r["count"] * SHARE // row["n"])) for r in rows if r["item"] is not None and r["count"] * SHARE > row["n"]]


def dealt_join(
    big: DataFrame, small: DataFrame, key: str, spread: Sequence[str], how: str = "inner", measure: DataFrame | None = None
) -> DataFrame:
    """Join by ``key`` where one key may hold a large share of ``big``.

    The share of each key is measured: a hot one gets as many parts as it holds shares, its rows of ``big`` go to one of
    them by their ``spread`` columns and its rows of ``small`` to all. Other keys are joined as they are, nothing of them is
    copied. ``measure`` may name a cheaper frame with the same shares, such as the one ``big`` derives from.
    """
    hot = hot_keys(big if measure is None else measure, key)
    if not hot:
        return big.join(small, key, how)
    kind = dict(small.dtypes)[key]
    known = F.broadcast(big.sparkSession.createDataFrame(hot, f"`{key}` {kind}, _parts int"))
    dealt = big.join(known, key, "left").withColumn(
        "_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts"))).cast("int")).drop("_parts")
    copies = small.join(known, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(copies, [key, "_part"], how).drop("_part")
