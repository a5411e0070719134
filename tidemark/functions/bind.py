"""Binding of derived columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns which later expressions read as plain values instead of repeating them.

    The optimizer inlines ordinary derived columns into every later use, also into filters pushed
    below them; the output of a generator is computed once per row.
    """
    fields = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(fields)))


def unfold(df: DataFrame, items: Column, *keep: str) -> DataFrame:
    """One row per struct of an array, next to the columns to keep.

    The array is bound first: the optimizer tests a generator's input for emptiness below it, which
    would compute the array twice.
    """
    return bind(df, _unfolded=items).select(*keep, F.inline("_unfolded"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression which reads ``value`` many times but computes it once; for use inside lambdas."""
    return F.transform(F.array(value), body)[0]
