"""Findings of round 3."""

import pickle
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import matching as mt
from tidemark.session import cut_lineage


def test_formats_are_tried_on_texts_of_their_shape_only(spark):
    texts = ["1 Mar 2024 10:00:00 +0200", "1 mar 2024 10:00:00", "1 Mar 2024", "Mar 1, 2024", "March 1, 2024", "Mar 01 2024", "March 1 2024",
             "2024/3/1", "2024-3-1 9:05", "32 Mar 2024", "March 1,2024", "1 March 2024", "2024/3/1 x", "later", "5-LOW", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    plain = F.coalesce(*[F.try_to_timestamp("v", F.lit(f)) for f, _ in dates._FORMATS])
    got = df.select(plain.alias("a"), dates.parse_timestamp(F.col("v")).alias("b"))
    rows = got.collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(r.b is not None for r in rows) == 9
    assert rows[0].b == datetime(2024, 3, 1, 8)
    # a failed parse throws inside: each format waits behind a pattern
    assert got.select("b")._jdf.queryExecution().analyzed().toString().lower().count("rlike") > len(dates._FORMATS)


def test_the_size_of_a_cut_result_is_what_was_written(spark):
    many = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.sha2(F.concat_ws("-", F.col("id"), i), 256))
    grown = cut_lineage(spark.range(4).select("id", F.explode(many).alias("text")))
    plan = grown.join(grown.withColumnRenamed("id", "other"), "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and grown.count() == 400_000


def test_roles_of_one_phrase_set_are_scored_in_the_task(spark, monkeypatch):
    monkeypatch.setattr(mt, "MEMBERS", 3)
    roles = [(f"r{i:02}", ["deep sea", "diver"]) for i in range(10)] + [("x", ["diver", "bell"]), ("y", ["nothing"])]
    lex = mt.lexicon(spark.createDataFrame(roles, "slug string, keywords array<string>"))
    items = spark.createDataFrame([(1, "A deep sea diver", "with a bell", ""), (2, "none", "", None), (3, "", "Divers", "diver")],
                                  "item_id long, title string, summary string, hint_text string")

    def rows(df):
        return sorted(tuple(r) for r in df.select("item_id", "slug", "score", "matched").collect())

    one = mt.role_scores(items, lex)
    assert rows(one) == rows(mt.candidate_scores(items, lex)) and len(rows(one)) == 22
    # nothing is joined behind the scoring
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(mt, "PART_BYTES", 400)
    assert rows(mt.role_scores(items, lex)) == rows(one)
    assert rows(mt.candidate_scores(items, lex)) == rows(one)
    monkeypatch.setattr(mt, "ROWS_HELD", 1)
    monkeypatch.setattr(mt, "ROWS_READ", 1)
    totals = {r.item_id: (r.roles, r.total) for r in mt.score_totals(items, lex).collect()}
    assert totals[3][0] == 11 and set(totals) == {1, 3}
    assert rows(mt.role_scores(items, lex)) == rows(one)
    assert mt.role_scores(items, lex.limit(0)).count() == 0 and mt.role_scores(items.limit(0), lex).count() == 0


def test_a_part_of_the_lexicon_holds_each_text_once(spark):
    lex = mt.lexicon(spark.createDataFrame([(f"r{i}", ["deep sea", f"word {i % 7}"]) for i in range(5000)], "slug string, keywords array<string>"))
    part = mt._Part.of(mt._role_parts(lex)[0].toArrow())
    assert len(part.phrases.texts) == 8 and len(part.phrases.roles) == 10_000
    assert len(pickle.dumps(part, 5)) < 60 * 5000
