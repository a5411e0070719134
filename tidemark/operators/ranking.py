"""Top rows per key and keep-one reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows per key.

    The filter sits directly on ``row_number``, so Spark plans a group limit below the shuffle:
    each map task sends at most ``k`` rows per key, whatever share of the rows a key holds.
    """
    name = rank or "_rank"
    kept = ranked(df, keys, order, name).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def last_value_first_position(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row per key: the values of the last position, ``first_position`` of the first one.

    An aggregate with map-side combine: a key with many copies ships one row per map task.
    """
    values = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*values), F.col(position)).alias("_last"),
            F.min(position).alias("first_position"),
        )
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values], "first_position")
    )


def union_keep_first(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where both have the key the first frame's row stays."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return first_per_key(both, keys, [F.col("_side").asc()]).drop("_side")


def union_last_wins(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return first_per_key(both, keys, [F.col("_side").desc()]).drop("_side")


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based positions in one order over all rows, without bringing them into one task.

    Range partitions are sorted on their own and materialised, so that counts and rows come from
    the same split; each row's position is its place in the partition plus the rows before it.
    """
    per_partition = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(
        per_partition.withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_id", 33)).withColumn("_offset", F.expr("_id & 8589934591"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition: bounded by the number of shuffle partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_offset") + 1)
        .drop("_part", "_start", "_offset", "_id")
    )
