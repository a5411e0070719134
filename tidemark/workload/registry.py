"""Name, callable and comparison SQL of every query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.views import table, view, with_views


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


class Inputs:
    """Tables and views of one data folder, read on access."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("fx_"):
            return view(self.spark, self.sf_dir, name)
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of ``Inputs`` under a name."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(
            run=lambda spark, sf_dir: fn(Inputs(spark, sf_dir)),
            sql=None if sql is None else with_views(sql),
        )
        return fn

    return register
