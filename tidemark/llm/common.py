"""Helpers shared by the operators: input tables, kept results and joins which stand hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_state_dir

#: Keys with more than one row in this many count as hot; so there are at most this many hot keys.
HOT_SHARE = 1000
#: Most rows (of two or three plain values) which are sent to every task; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a result once to the cluster's shared folder and read it from there."""
    path = new_state_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_unique(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``big`` with at most one row of ``small`` for each non-null key, whatever the keys' frequencies.

    Rows of hot keys meet a broadcast of those keys' rows, at most ``HOT_SHARE`` by arithmetic; all other keys
    are joined by a shuffle in which no key has more than that share. ``big`` is read three times: keep it first.
    """
    counts = big.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.filter(F.col("count") > max(1, total // HOT_SHARE)).select(key)
    warm = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))
    cold = big.join(F.broadcast(hot), key, "left_anti").join(small, key, how)
    in_hot = big.join(F.broadcast(hot), key, "left_semi").join(warm, key, how)
    return in_hot.unionByName(cold)


def sent_if_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A frame of at most that many rows goes to every task; a larger one is left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not among ``ids``; only a counted, bounded list is sent to the tasks."""
    return docs.join(sent_if_bounded(ids), key, "left_anti")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_text(column: str) -> Column:
    """An id as text; null ids count as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
