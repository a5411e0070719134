"""Licence scan: texts in a canonical form are looked up by digest among known licences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.bind import bind
from tidemark.llm.common import BROADCAST_ROWS

#: Short notices by SPDX identifier. Callers give further ones, and full texts, as a table.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1-only", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Spellings which count as equal, after lower case and with punctuation as single spaces.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("non commercial", "noncommercial"),
    ("version", "v"), ("per cent", "percent"), ("copyright holder", "copyright owner"),
)
#: A line which states a copyright and nothing else that must match.
COPYRIGHT = r"^\W*(?:copyright|©|\(c\))(?:\s*(?:©|\(c\)))?[\s,]*[0-9]{4}.*$|^\W*all rights reserved\W*$"


def canonical_lines(text: Column) -> Column:
    """Lines of a text in canonical form; a copyright line becomes empty."""
    def line(x: Column) -> Column:
        low = F.lower(x)
        out = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
        for a, b in SPELLINGS:
            out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
        return F.when(low.rlike(COPYRIGHT), "").otherwise(F.trim(out))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def catalogue(spark: SparkSession, notices: Iterable[tuple[str, str]] = NOTICES) -> DataFrame:
    return spark.createDataFrame(list(notices), "licence string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """(licence, digest) of the canonical whole texts of a catalogue (licence, text)."""
    made = known.select("licence", whole(canonical_lines(F.col("text"))).alias("_c"))
    return made.filter("_c <> ''").select("licence", F.md5("_c").alias("digest")).distinct()


def matches(docs: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, unit, licence, n): licences whose canonical text is the whole text (``text``) or a line (``notice``).

    Null and empty texts match nothing, and so does a text of copyright lines only; texts are taken whole; a text that
    is one line matches in both units; lines that repeat and repeated rows add to ``n``; two licences of one canonical
    text both match; null keys are kept as such; empty tables give no rows; further columns are ignored.
    """
    digests = known_digests(known)
    if digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    lines = bind(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), _l=canonical_lines(F.col("_t")))
    units = F.concat(
        F.transform("_l", lambda x: F.struct(F.lit("notice").alias("unit"), F.md5(x).alias("digest"))),
        F.array(F.struct(F.lit("text").alias("unit"), F.md5(whole(F.col("_l"))).alias("digest"))))
    found = bind(lines.select("_k", "_l"), _u=units).select("_k", F.inline("_u")).join(digests, "digest")
    return found.groupBy(F.col("_k").alias(key), "unit", "licence").agg(F.count("*").alias("n"))


def duckdb_lines(column: str) -> str:
    """The canonical lines as DuckDB SQL, for comparison."""
    out = "' ' || trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return (f"list_transform(string_split(coalesce({column}, ''), chr(10)), lambda x: CASE WHEN regexp_matches(lower(x), "
            f"'{COPYRIGHT}') THEN '' ELSE trim({out}) END)")


def canonical_notices() -> list[tuple[str, str]]:
    """The fixed notices in canonical form, worked out without Spark."""
    import re

    out = set()
    for licence, notice in NOTICES:
        low = " " + re.sub(r"[\W_]+", " ", notice.lower()).strip() + " "
        for a, b in SPELLINGS:
            low = low.replace(f" {a} ", f" {b} ")
        out.add((licence, low.strip()))
    return sorted(out)
