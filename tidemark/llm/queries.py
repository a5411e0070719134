"""Registered queries of the operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate, jaccard, langid, licences, nearest, pagetext, phrases, runs, secrets, sentencepiece_bpe, sharding, simhash,
    tokencounts,
)
from tidemark.functions.bind import bind
from tidemark.llm.common import read, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


@query("op2_licence_digests", r"""
WITH known AS (SELECT * FROM (VALUES {known}) AS k(licence, notice)),
d AS (SELECT doc_id, {lines} AS lines FROM documents),
units AS (SELECT doc_id, 'notice' AS unit, unnest(lines) AS canonical FROM d
          UNION ALL SELECT doc_id, 'text', array_to_string(list_filter(lines, lambda x: x <> ''), ' ') FROM d)
SELECT doc_id, unit, licence, count(*) AS n
FROM units JOIN known ON canonical = notice GROUP BY ALL""".format(
    known=", ".join(f"('{i}', '{t}')" for i, t in licences.canonical_notices()), lines=licences.duckdb_lines("text")))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return licences.matches(docs, "doc_id", "text", licences.catalogue(spark))


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return secrets.digest(secrets.scan(docs, "doc_id", "text", "source", by_passage=True))


@query("op4_rendezvous_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return sharding.shard_rows(docs, "doc_id", "text", [1.0] * 8, [1.0] * 9)


@query("op6_simhash_components")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash.near_duplicates(docs, "doc_id", "text")
    return found.select("doc_id", simhash.as_hex(found["fp"]).alias("fingerprint"), "component_id")


@query("op7_sentencepiece_ids")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return sentencepiece_bpe.token_digests(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = langid.train(langid.sample(docs, "doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), "text", net)
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op1_spaced_seed_overlaps", r"""
WITH masks(n, places) AS (VALUES (0, [0, 4, 5, 6, 8, 10]), (1, [0, 1, 2, 3, 5, 10]), (2, [0, 2, 6, 8, 9, 10])),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS h
      FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS b
      FROM benchmark),
dw AS (SELECT doc_id, h, unnest(range(len(h) - 10)) AS pos FROM d WHERE len(h) >= 11),
bw AS (SELECT item_id, b, unnest(range(len(b) - 10)) AS jb FROM b WHERE len(b) >= 13),
ds AS (SELECT doc_id, h, pos, n, array_to_string([h[pos + p + 1] FOR p IN places], ' ') AS key FROM dw, masks),
bs AS (SELECT item_id, b, jb, n, array_to_string([b[jb + p + 1] FOR p IN places], ' ') AS key FROM bw, masks),
hit AS (SELECT doc_id, item_id, h, b, pos, jb FROM ds JOIN bs USING (n, key))
SELECT doc_id, item_id, count(*) AS hits, min(pos) AS first_token
FROM hit
WHERE len([lo FOR lo IN [-2, -1, 0] IF pos + lo >= 0 AND jb + lo >= 0 AND pos + lo + 13 <= len(h)
           AND jb + lo + 13 <= len(b)
           AND len([i FOR i IN range(13) IF h[pos + lo + i + 1] = b[jb + lo + i + 1]]) >= 11]) > 0
GROUP BY ALL""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contaminated(docs, "doc_id", "text", items, "item_id", "text")


@query("op8_projected_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


@query("op5_page_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id", "url", "html")


#: What the token count query edits: addresses and long numbers are masked, line breaks become blank lines.
EDITED = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|[0-9]{4,}|\n+"


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.found(text_or_empty(), 0, "edit", EDITED, 0, 1)
    edits = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(
        s["value"].startswith("\n"), F.lit("\n\n")).otherwise("<mask>").alias("new")))
    return tokencounts.count_edited(docs.withColumn("edits", edits), "doc_id", "text", "edits",
                                    public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = runs.find(bind(docs, repeated=runs.with_repeats("doc_id", "text")), "doc_id", "repeated")
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"], r["period"])))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = bind(found, _best=F.get(best, F.lit(0)))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), (-F.col("_best.n")).alias("length"),
        F.col("_best.period").alias("period"), F.expr("1000 * -_best.n div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Phrases listed for each language.
LISTED = 2000


@query("op13_phrase_stripes", r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest([w[i:i + m - 1] FOR i IN range(1, len(w) - m + 2)]) AS g FROM w, (VALUES (1), (2), (3)) AS s(m)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM f WHERE f >= 10 AND len(g) BETWEEN 2 AND 3),
longer AS (SELECT lang, g, max(a) AS a FROM (
    SELECT lang, g[1:2] AS g, a FROM c WHERE len(g) = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE len(g) = 3) GROUP BY ALL),
left_over AS (SELECT c.* FROM c LEFT JOIN longer l ON c.lang = l.lang AND c.g = l.g WHERE l.a IS NULL OR 100 * l.a < 50 * c.a),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM left_over),
scored AS (SELECT cuts.lang, cuts.g, a, k, x.f AS l, y.f AS r,
                  (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = cuts.g[1:k] JOIN f y ON y.lang = cuts.lang AND y.g = cuts.g[k + 1:len(cuts.g)]),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS c FROM scored),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM weakest WHERE c = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN n USING (lang) QUALIFY rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "lang", "text")
    found = phrases.collocations(docs, "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LISTED)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op11_jaccard_components", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) AS s
      FROM w WHERE len(w) > 0),
x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id
FROM w LEFT JOIN s USING (doc_id) LEFT JOIN low ON low.a = w.doc_id""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", words=4, over=17, under=20)
