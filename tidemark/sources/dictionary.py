"""Role dictionary from a one-column CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.text import build_keywords, slugify, trim_all
from tidemark.operators.ranking import global_positions



def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of one-column files in file order, header and blank lines dropped.

    Commas inside a name are part of it. Order columns: ``file``, ``block``, ``line``.
    """
    lines = spark.read.text(path).select(
        trim_all(F.col("value")).alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    ).filter(F.length("text") > 0)
    headers = lines.groupBy("file").agg(F.min(F.struct("block", "line")).alias("_h")).select(
        "file", F.col("_h.block").alias("block"), F.col("_h.line").alias("line")
    )
    quoted = F.startswith("text", F.lit('"')) & F.endswith("text", F.lit('"')) & (F.length("text") > 1)
    inner = F.expr("substring(text, 2, length(text) - 2)")
    name = F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.col("text"))
    return lines.join(headers, ["file", "block", "line"], "left_anti").select(
        "file", "block", "line", name.alias("name_en")
    )


FILE_ORDER = ("file", "block", "line")


def translated(roles: DataFrame, translations: DataFrame) -> DataFrame:
    """Chinese name by exact English name, the English one where none is known."""
    side = translations.select("name_en", F.col("name_zh").alias("_zh"))
    return (
        roles.join(side, "name_en", "left")
        .withColumn("name_zh", F.coalesce("_zh", "name_en"))
        .drop("_zh")
    )


def source_codes(
    names: DataFrame, code_of_name: dict[str, str] | None = None, order: tuple[str, ...] = FILE_ORDER
) -> DataFrame:
    """``csv-role-{n}`` by file order; a name with an own code keeps that."""
    numbered = global_positions(names, [F.col(c).asc() for c in order], "ordinal")
    code = F.concat(F.lit("csv-role-"), F.col("ordinal").cast("string"))
    for name, own in (code_of_name or {}).items():
        code = F.when(F.col("name_en") == name, own).otherwise(code)
    return numbered.withColumn("source_code", code)


PRESERVED = "source_code string, occupation_code string, slug string, name_en string, name_zh string, keywords array<string>"


def preserved_roles(spark: SparkSession) -> DataFrame:
    """The roles that stay in every dictionary unless a caller keeps a table of its own."""
    return spark.createDataFrame([(c, o, s, en, zh, list(k)) for c, o, s, en, zh, k in rules.PRESERVED_ROLES], PRESERVED)


def role_dictionary(names: DataFrame, translations: DataFrame, preserved: DataFrame | None = None,
                    order: tuple[str, ...] = FILE_ORDER) -> DataFrame:
    """Slug, codes, names, group and keywords of every name, plus the preserved roles no name has the slug of.

    ``preserved``: source_code, occupation_code, slug, name_en, name_zh, keywords. They come after all names.
    """
    overrides = rules.DICTIONARY_OVERRIDES
    codes = {name: code for name, (_, code, _) in overrides.items()}
    slug = slugify(F.col("name_en"))
    occupation = F.lit(None).cast("string")
    keywords = build_keywords(F.col("name_en"))
    for name, (own_slug, own_code, own_keywords) in overrides.items():
        hit = F.col("name_en") == name
        slug = F.when(hit, own_slug).otherwise(slug)
        occupation = F.when(hit, own_code).otherwise(occupation)
        if own_keywords:
            keywords = F.when(hit, F.array(*[F.lit(k) for k in own_keywords])).otherwise(keywords)
    listed = translated(source_codes(names, codes, order), translations).select(
        "ordinal", "source_code", occupation.alias("occupation_code"), slug.alias("slug"), "name_en",
        "name_zh", F.lit(rules.DICTIONARY_GROUP).alias("industry_code"), keywords.alias("keywords"),
    )
    last = F.lit(9_000_000_000_000_000_000).cast("long").alias("ordinal")
    more = (preserved_roles(names.sparkSession) if preserved is None else preserved).select(
        last, "*", F.lit(rules.DICTIONARY_GROUP).alias("industry_code"))
    return listed.unionByName(more.join(listed.select("slug"), "slug", "left_anti").select(listed.columns))
