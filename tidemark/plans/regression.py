"""Checks of attribution and scores against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.matching import compare_labels, pass_counts


SCORE_CASE = (
    "id string, roleSlug string, expectedReplacementRateMin int, expectedReplacementRateMax int, expectedRiskBand string, note string, "
    "items array<struct<sourceLabel: string, sourceType: string, publishedAt: string, title: string, summaryEn: string, "
    "impactDirection: string, signalType: string>>"
)
ATTRIBUTION_CASE = (
    "id string, sourceLabel string, sourceType string, sourceUrl string, title string, summary string, "
    "expectedAssignedRoleSlug string, note string"
)


def read_cases(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> DataFrame:
    """Cases of JSON files. A whole file is one list, as people write it; else each line is a case or a list of cases.

    Fields which a file leaves out are NULL; a field of a wrong type or a broken file is an error, never a missing case.
    """
    return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "FAILFAST").json(path)


def attribution_items(cases: DataFrame) -> DataFrame:
    """The items of attribution cases in the shape the classification takes."""
    return cases.select(
        F.col("id").alias("item_id"), F.lit("regression").alias("source_catalog_id"), F.col("sourceUrl").alias("source_url"),
        F.col("sourceType").alias("source_type"), "title", "summary", F.array().cast("array<string>").alias("hints"),
        F.lit("").alias("hint_text"))


def signal_type(item: Column) -> Column:
    """The signal type of a case's evidence where it states none: hiring for postings, tooling for neutral ones, else adoption."""
    return F.coalesce(item["signalType"], F.when(item["sourceType"].isin("jobs", "JOB_POSTING"), "HIRING_SHIFT").when(
        item["impactDirection"] == "neutral", "TOOLING").otherwise("ADOPTION"))


def score_inputs(cases: DataFrame, state: DataFrame) -> DataFrame:
    """One row for each case with its role's state and its evidence; an unknown role is an error.

    ``state``: slug and the fields a scorer is told.
    """
    told = F.transform("items", lambda i: i.withField("signalType", signal_type(i)))
    known = cases.withColumn("items", told).join(state.withColumnRenamed("slug", "roleSlug").withColumn("_known", F.lit(True)), "roleSlug", "left")
    unknown = F.raise_error(F.concat(F.lit("Unknown role slug in score cases: "), F.coalesce("roleSlug", F.lit("none")))).cast("boolean")
    return known.filter(F.coalesce("_known", unknown)).drop("_known")


def attribution_report(cases: DataFrame, classified: DataFrame) -> DataFrame:
    """Expected against assigned role per case."""
    expected = cases.select("id", F.col("expectedAssignedRoleSlug").alias("value"))
    actual = classified.select(F.col("item_id").alias("id"), F.col("c.assigned_slug").alias("value"))
    return compare_labels(expected, actual, "id")


def score_report(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """Whether each rate lies in its range and the band is the expected one.

    ``scores``: id, replacement_rate, risk_band.
    """
    joined = cases.join(scores, "id", "left")
    in_range = F.col("replacement_rate").between(
        F.col("expectedReplacementRateMin"), F.col("expectedReplacementRateMax")
    )
    band_ok = F.col("risk_band") == F.col("expectedRiskBand")
    return joined.select(
        "id", "replacement_rate", F.coalesce(in_range, F.lit(False)).alias("in_range"),
        F.coalesce(band_ok, F.lit(False)).alias("band_ok"),
        F.coalesce(in_range & band_ok, F.lit(False)).alias("ok"),
    )


def summary(report: DataFrame) -> DataFrame:
    return pass_counts(report)
