"""Validation of model results, batches of models, relevance per page, addresses, script winners, hot keys."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.urls import canonical
from tidemark.operators import catalogue as cat
from tidemark.operators.joins import dealt_join, hot_keys
from tidemark.operators.timeline import since_boundaries
from tidemark.plans import classify as cl
from tidemark.plans import refresh
from tidemark.sources import listing, pages

GOOD = {
    "assignedRoleSlug": "r1", "sourceKind": "official", "signalType": "adoption_case", "relevance": "high",
    "impactDirection": "increase", "explanation": "why", "summaryEn": "what", "summaryZh": None, "signalWeight": "primary",
}
SCORE = {
    "replacement_rate": 40, "risk_band": "medium", "summary_en": "s", "summary_zh": None,
    "reasons": [{"kind": "media", "title_en": "t", "detail_en": "d", "title_zh": None}],
}


def verdicts(spark, check, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", check(F.col("j")).isNotNull().alias("ok"))
    return [r.ok for r in rows.orderBy("i").collect()]


def test_classifications_need_their_types(spark):
    def but(**fields):
        return json.dumps({k: v for k, v in {**GOOD, **fields}.items() if v != "absent"})

    good = [but(), but(assignedRoleSlug=None), but(summaryZh="zh"), but(summaryZh="absent")]
    bad = [but(explanation=5), but(assignedRoleSlug=3), but(summaryEn={"a": 1}), but(assignedRoleSlug="absent"), but(relevance="huge"),
           but(summaryEn=""), but(assignedRoleSlug=""), but(signalWeight=["primary"]), but(explanation="absent"), "no json", None, "[]",
           json.dumps({"nested": GOOD}), json.dumps({**GOOD, "assignedRoleSlug": "absent", "x": '"assignedRoleSlug": 1'})[:-1]]
    assert verdicts(spark, cl.valid_result, good) == [True] * len(good)
    assert verdicts(spark, cl.valid_result, bad) == [False] * len(bad)


def test_scores_need_their_types(spark):
    reason = SCORE["reasons"][0]

    def but(**fields):
        return json.dumps({**SCORE, **fields})

    good = [but(), but(replacement_rate=0), but(replacement_rate=40.0), but(summary_zh="zh"), but(reasons=[reason] * 5)]
    bad = [but(replacement_rate=40.5), but(replacement_rate=101), but(replacement_rate="40"), but(risk_band="odd"), but(summary_en=""),
           but(reasons=[]), but(reasons=[reason] * 6), but(reasons=[{**reason, "kind": "rumour"}]), but(reasons=[{**reason, "title_en": ""}]),
           but(reasons=[reason, {**reason, "detail_en": 4}]), but(reasons=[{**reason, "title_zh": ""}]), but(reasons="none"), "{", None]
    assert verdicts(spark, refresh.valid_score, good) == [True] * len(good)
    assert verdicts(spark, refresh.valid_score, bad) == [False] * len(bad)


def test_a_failing_batch_is_halved(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        calls.add(len(batch))
        if (batch["k"] == 37).any():
            raise ValueError("bad row")
        return pd.DataFrame({"k": batch["k"], "result": "r", "provider": "p", "model": "m"})

    rows = cl.run_model(spark.range(64).withColumnRenamed("id", "k").coalesce(1), model, "k", ["k"]).collect()
    assert [r.k for r in rows if r.error] == [37] and len(rows) == 64
    assert calls.value == 64 + 2 * (32 + 16 + 8 + 4 + 2 + 1)


def test_relevance_is_ranked_within_a_page(spark):
    rows = [("p1", "plain", "2024-01-02", "u1"), ("p1", "ring", "2024-01-01", "u2"), ("p2", "plain", "2024-01-01", "u3"),
            ("p2", "plain", "2024-01-03", "u4"), ("p2", "plain", None, "u5")]
    items = spark.createDataFrame(rows, "page string, title string, published_at string, source_url string").withColumn("summary", F.lit(""))
    got = {(r.page, r.source_url): r.relevance_rank for r in listing.by_relevance(items, ["page"], ((r"\bring\b", 5),)).collect()}
    assert got == {("p1", "u2"): 1, ("p1", "u1"): 2, ("p2", "u4"): 1, ("p2", "u3"): 2, ("p2", "u5"): 3}
    assert {r.source_url for r in listing.by_relevance(items, ["page"], ((r"\bring\b", 5),), limit=1).collect()} == {"u2", "u4"}


def test_escaped_and_plain_letters_are_one_address(spark):
    pairs = [("https://a.test/é x?q='ü'#ab<c", "https://a.test/%C3%A9%20x?q=%27%C3%BC%27#ab%3Cc"), ("https://a.test/日", "https://a.test/%E6%97%A5"),
             ("https://a.test/\U0001F600/{b}", "https://a.test/%F0%9F%98%80/%7Bb%7D")]
    for a, b in spark.createDataFrame(pairs, "a string, b string").select(canonical(F.col("a")), canonical(F.col("b"))).collect():
        assert a == b


def test_the_last_script_wins_and_flat_fields_are_texts(spark):
    one = '{"article": {"title": "%s title", "href": "/news/x", "date": "2024-05-01"}}'
    html = "".join(f"<script id='__NEXT_DATA__'>{one % w}</script>" for w in ("first", "second", "last"))
    flat = ('<script>{"Id": 7, "title": "good one", "addtime": "2024-05-01"} {"Id": 8, "title": 12345, "addtime": "2024-05-01"} '
            '{"Id": "9", "title": "no date", "addtime": 20240501}</script>')
    df = spark.createDataFrame([(1, html, "https://a.test/"), (2, flat, "https://a.test/")], "page_id int, html string, base_url string")
    assert [r.title for r in pages.json_items(df.filter("page_id = 1")).collect()] == ["last title"]
    flat_rows = pages.flat_record_items(df.filter("page_id = 2")).collect()
    assert {r.source_url for r in flat_rows} <= {"https://a.test/news/7"}


def test_missing_featured_topics_are_an_error(spark):
    with pytest.raises(ValueError, match="nowhere"):
        cat.featured_topics(spark.range(1), ["nowhere"], {"a": (None, 1, 2)})


def test_half_of_all_rows_on_one_role(spark):
    big = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), "id")).alias("slug"), "id")
    small = spark.createDataFrame([("hot", 1), ("r1", 2), ("rx", 3)], "slug string, v int")
    [(key, parts)] = hot_keys(big, "slug")
    assert key == "hot" and 30 <= parts <= 34 and hot_keys(big.filter("slug <> 'hot'"), "slug") == [] and hot_keys(big.limit(0), "slug") == []
    joined = dealt_join(big, small, "slug", ["id"])
    assert joined.groupBy("slug").count().orderBy("slug").collect() == [("hot", 2000), ("r1", 1)]
    assert dealt_join(big, small, "slug", ["id"], "left").count() == 4000
    assert dealt_join(big, small, "slug", ["id"], "left_anti").count() == 1999
    line = spark.createDataFrame([("hot", 1, "2024-01-02"), ("hot", 2, "2024-01-01")], "slug string, timeline_rank int, published_at string")
    got = since_boundaries(line, big.withColumn("boundary", F.lit("2024-01-01")), 2)
    assert got.count() == 2000


def test_a_repeated_run_replaces_what_it_wrote(spark):
    from datetime import datetime

    from tidemark.operators.commits import commit, committed
    from tidemark.session import new_state_dir

    root, now = new_state_dir(spark, "runs"), datetime(2024, 1, 1)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    assert committed(spark, root, ["a", "b"]) is None
    commit(spark, root, 1, {"a": frame((1, "x")), "b": frame((9, "y"))}, now)
    commit(spark, root, 2, {"a": frame((1, "late")), "b": frame()}, now)
    commit(spark, root, 2, {"a": frame((1, "again"), (2, "z")), "b": frame()}, now)
    assert sorted(map(tuple, committed(spark, root, ["a"])["a"].collect())) == [(1, "again"), (2, "z")]
    assert [tuple(r) for r in committed(spark, root, ["a", "b"], before=2)["b"].collect()] == [(9, "y")]


def test_a_run_that_wrote_tables_but_no_commit_is_not_read(spark):
    from datetime import datetime

    from tidemark.operators.commits import commit, committed
    from tidemark.session import new_state_dir

    root = new_state_dir(spark, "runs")
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    commit(spark, root, 1, {"a": one}, datetime(2024, 1, 1))
    one.withColumn("v", F.lit("lost")).write.parquet(f"{root}/a/run=2")
    assert [tuple(r) for r in committed(spark, root, ["a"])["a"].collect()] == [(1, "x")]


def test_score_cases_of_files_as_people_write_them(spark, tmp_path):
    from tidemark.plans import regression

    (tmp_path / "cases.json").write_text('''[
      {"id": "a", "roleSlug": "r1", "expectedReplacementRateMin": 1, "expectedReplacementRateMax": 9, "expectedRiskBand": "low",
       "items": [{"sourceType": "jobs", "title": "t"}, {"sourceType": "NEWS", "impactDirection": "neutral"}, {"signalType": "OWN"}]},
      {"id": "b", "roleSlug": "r2", "items": []}
    ]''', encoding="utf8")
    cases = regression.read_cases(spark, str(tmp_path), regression.SCORE_CASE)
    state = spark.createDataFrame([("r1", "One"), ("r2", "Two")], "slug string, name_en string")
    got = {r.id: [i.signalType for i in r["items"]] for r in regression.score_inputs(cases, state).collect()}
    assert got == {"a": ["HIRING_SHIFT", "TOOLING", "OWN"], "b": []}
    with pytest.raises(Exception, match="Unknown role slug in score cases: r2"):
        regression.score_inputs(cases, state.filter("slug = 'r1'")).collect()


def test_names_sort_for_readers(spark):
    from tidemark.functions.text import by_name

    names = ["zebra", "Äpfel", "apple", "Apple", "Zoo", "apples", "éclair", "-dash", "Eclair"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(by_name(F.col("n"))).collect()]
    assert got == ["-dash", "Äpfel", "apple", "Apple", "apples", "Eclair", "éclair", "zebra", "Zoo"]
