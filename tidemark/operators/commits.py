"""Several tables that change together, one numbered run after the other."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.state import path_exists


def committed(spark: SparkSession, root: str, names: Iterable[str], before: int | None = None) -> dict[str, DataFrame] | None:
    """Tables of the newest committed run, or of the newest below ``before``; None where there is none."""
    if not path_exists(spark, f"{root}/commits"):
        return None
    runs = spark.read.parquet(f"{root}/commits")  # one row a run
    known = runs if before is None else runs.filter(F.col("run") < before)
    newest = known.agg(F.max("run")).first()[0]
    return None if newest is None else {n: spark.read.parquet(f"{root}/{n}/run={newest}") for n in names}


def commit(spark: SparkSession, root: str, run: int, tables: Mapping[str, DataFrame], now: datetime) -> dict[str, DataFrame]:
    """Write all tables under the run's number, its commit last, and read them back.

    A reader sees the whole run or none of it. A run that is repeated replaces what it wrote, as long as its tables come from
    the runs before it.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    spark.createDataFrame([(now,)], "at timestamp").coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/run={run}")
    return committed(spark, root, tables, run + 1)
