"""What the home page shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.presentation import has_chinese_name, local_name, present
from tidemark.operators import catalogue as cat


@dataclass(frozen=True)
class HomeView:
    rows: DataFrame
    ranking: DataFrame
    suggestions: DataFrame


def home_view(dictionary: DataFrame, rows: DataFrame, locale: str) -> HomeView:
    """Rows, ranking and suggestions; the locale filter comes after each cut."""
    en, zh = F.col("name_en"), F.col("name_zh")

    def local(df: DataFrame) -> DataFrame:
        shown = df.filter(has_chinese_name(en, zh)) if locale == "zh" else df
        return shown.withColumn("name", local_name(en, zh, locale))

    listed = local(cat.home_list(rows))
    shown = present(
        F.col("risk_level"), F.col("rating_status"), locale, F.col("replacement_rate"),
        F.col(f"risk_summary_{locale}"),
    )
    secondary = F.lit("") if locale == "zh" else zh
    return HomeView(
        rows=listed.select("slug", "name", *[c.alias(n) for n, c in shown.items()]),
        ranking=local(cat.home_ranking(rows)).select("slug", "name", "replacement_rate"),
        suggestions=local(cat.suggestions(dictionary, rules.HOME_WORKING_SET)).select(
            "slug", "name", secondary.alias("secondary")
        ),
    )
