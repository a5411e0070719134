"""Sharding by rendezvous hashing: each key goes to the shard with the highest weighted score for it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_text

#: Rows which a numbering group should hold, and most groups of a shard; 8 bytes for each go to every task.
GROUP_ROWS, MOST_GROUPS = 1_000, 8_192


def uniform(key: Column, salt: str) -> Column:
    """A value above 0 and below 1 that depends on key and salt alone: 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{salt}"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest -weight / ln(u) for the key; ties go to the smaller shard.

    A shard of twice the weight gets twice the keys. A change of weight or a new shard touches no other shard's
    score, so a key moves only when it goes to or comes from the changed shard.
    """
    scored = [F.struct((F.lit(-float(w)) / F.ln(uniform(key, str(i)))).alias("score"), F.lit(-i).alias("shard"))
              for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scored))["shard"]).cast("int")


def shard_rows(df: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Shard, gapless slot in the shard, and the shard after growth, for every row.

    Slots: a shard's keys fall into groups by digest; a first pass counts the groups from the key column alone, and
    the counts' running sums (at most MOST_GROUPS for each shard) are the groups' first slots. Thus no task
    numbers a whole shard. Null keys count as the empty key, null texts have size 1 and checksum 0, repeated rows each
    get a slot of their own (same shard), an empty table gives no rows, further columns are ignored.
    """
    keyed = df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), id_text(key).alias("_key"))
    n = keyed.count()
    groups = max(1, min(MOST_GROUPS, n // GROUP_ROWS))
    placed = keyed.withColumn("shard", rendezvous(F.col("_key"), weights)).withColumn(
        "_group", F.pmod(F.xxhash64("_key"), F.lit(groups)).cast("int"))
    counts = placed.groupBy("shard", "_group").count()
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    sized = placed.select(
        "doc_id", "shard", "_group",
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("_text"), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col("_key"), grown).alias("grown_shard"),
    )
    within = Window.partitionBy("shard", "_group").orderBy("doc_id", "size", "text_crc32")
    return (
        sized.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(first), ["shard", "_group"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("_first") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
    )
