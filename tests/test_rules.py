"""Value rules on literal rows."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import dates, html, policy, presentation, rates, text, urls
from tidemark.functions.profile import profile_columns, profile_text
from tidemark.operators.trend import trend


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_halves_round_up_also_below_zero(spark):
    got = values(spark, [-2.5, -0.5, 0.5, 54.5, 200.0, None], rates.clamp_rate(F.col("v")), "v double")
    assert got == [5, 5, 5, 55, 95, None]
    assert values(spark, [-2.5, 2.5], rates.round_half_up(F.col("v")), "v double") == [-2, 3]


def test_bands(spark):
    assert values(spark, [80, 79, 55, 54, 30, 29, None], rates.band(F.col("v")), "v int") == [
        "SEVERE", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", None]


def test_weight_clamp(spark):
    got = values(spark, [float("nan"), float("inf"), None, -1.0, 0.456, 2.0], rates.clamp_weight(F.col("v")), "v double")
    assert got == [0.0, 0.0, 0.0, 0.0, 0.46, 1.0]


def test_canonical_url(spark):
    cases = {
        "HTTPS://WWW.Example.com": "https://example.com/",
        "http://a.test:80/x?utm_source=1&q=2#f": "http://a.test/x?q=2#f",
        "https://a.test:8443/x?Ref=1": "https://a.test:8443/x",
        "https://a.test/x?reference=1&b=%20": "https://a.test/x?reference=1&b=%20",
        "https://a.test/a/../b/./c": "https://a.test/b/c",
        "https://user@www.a.test/p?SPM=1&a=1": "https://user@a.test/p?a=1",
        "not a url": "not a url",
    }
    assert values(spark, list(cases), urls.canonical(F.col("v"))) == list(cases.values())


def test_hosts(spark):
    rows = ["https://WWW.Example.com/a", "https://notexample.com", "nope", None]
    assert values(spark, rows, urls.host(F.col("v"))) == ["example.com", "notexample.com", None, None]
    assert values(spark, rows, urls.is_public(F.col("v"))) == [False, True, False, False]
    assert values(spark, rows[:2], urls.mentions_example(F.col("v"))) == [True, True]


def test_resolve_link(spark):
    base = F.lit("https://s.test/a/b.html?x=1")
    cases = {"c": "https://s.test/a/c", "../c": "https://s.test/c", "/r": "https://s.test/r", "//o.test/z": "https://o.test/z",
             "?q": "https://s.test/a/b.html?q", "mailto:x@y": "mailto:x@y", "https://O.test": "https://o.test/"}
    assert values(spark, list(cases), urls.resolve(F.col("v"), base)) == list(cases.values())


def test_page_types(spark):
    rows = [
        ("https://x.test/blog/", "t", "2024"), ("https://x.test/en-us", "t", "2024"),
        ("https://x.test/a/b", "The future of work", None), ("https://x.test/news/b", "The future of work", None),
        ("https://www.bls.gov/ooh/x/y", "t", None), ("https://x.test/industry/bank", "AI platform", None), ("bad", "platform", None),
    ]
    df = spark.createDataFrame(rows, "u string, t string, p string")
    got = [tuple(r) for r in urls.with_page_types(df, F.col("u"), F.col("t"), F.col("p")).select("landing", "evergreen", "reference", "vertical").collect()]
    assert got == [
        (True, False, False, False), (True, False, False, False), (False, True, False, False), (False, False, False, False),
        (False, False, True, False), (False, False, False, True), (False, False, False, False)]


def test_tolerant_dates(spark):
    rows = ["2026-03-20", "2026-03-20T10:00:00Z", "Fri, 20 Mar 2026 12:00:00 +0200", "Fri, 20 Mar 2026 10:00:00 GMT", "March 20, 2026", "soon", ""]
    day, ten = datetime(2026, 3, 20), datetime(2026, 3, 20, 10)
    assert values(spark, rows, dates.parse_timestamp(F.col("v"))) == [day, ten, ten, ten, day, None, None]


def test_markup_is_decoded_before_tags_go(spark):
    assert values(spark, ["a&lt;b&gt;c <i>d</i>&nbsp; e", "x &amp;lt;y&amp;gt;"], html.strip(F.col("v"))) == ["a c d e", "x"]
    assert values(spark, ["Title  Tag: x"], html.clean_title(F.col("v"))) == ["Title"]


def test_word_bounds_know_ascii_only(spark):
    assert values(spark, ["a task", "multitasks", "étask", "task_1"], text.has_workflow_language(F.col("v"))) == [True, False, True, False]


def test_unicode_fold(spark):
    # a mark which the normal form splits off leaves a gap
    assert values(spark, ["École ﬁ 软件!"], text.fold_unicode(F.col("v"))) == ["e cole fi 软件"]


def test_term_expansion(spark):
    df = spark.createDataFrame([(["Finance Companies", " "],)], "k array<string>")
    got = set(df.select(text.expand_terms(F.col("k"))).first()[0])
    assert got == {"finance companies", "finance", "companies", "company", "financial"}


def test_strategy_flag_needs_a_json_boolean(spark):
    rows = ['{"strategyCanAffectReplacementRate": false}', '{"strategyCanAffectReplacementRate": "false"}', "[1]", "x", None]
    df = spark.createDataFrame([(r,) for r in rows], "raw_json string")
    assert [r[0] for r in policy.with_raw_fields(df).select("raw_veto").collect()] == [False, None, None, None, None]


def test_policy_type_keys_in_order(spark):
    rows = [('{"signalType": "x", "sourceValue": " tooling "}', "BLOG"), ('{"value": 3}', "JOB_POSTING"), (None, "COMPANY_UPDATE"), (None, "NEWS")]
    df = spark.createDataFrame(rows, "raw_json string, t string")
    got = policy.with_raw_fields(df).select(policy.policy_signal_type(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == ["TOOLING", "HIRING_SHIFT", "ADOPTION", "TOOLING"]


def test_signal_is_kept_on_the_weight_before_the_discount(spark):
    df = spark.createDataFrame([("media", "discovery-x", "high", "secondary")], "c string, s string, r string, w string")
    p = policy.signal_policy(F.col("c"), F.col("s"), F.lit("slug"), F.lit("adoption_case"), F.lit(True), F.col("r"), F.col("w"),
                             F.lit("media"), F.lit("adoption_case"))
    row = df.select(p.alias("p")).first().p
    assert row.signal_weight == 0.4 and row.keep_signal and row.signal_strength == "LOW"


def test_profile_substrings_and_limits(spark):
    df = spark.createDataFrame([("field-coder", "Field Coder", ["code"], 9), ("x", "X", [], 0)], "s string, n string, k array<string>, c int")
    cols = profile_columns(profile_text(F.col("s"), F.col("n"), F.col("k")), F.col("c"))
    got = [tuple(r) for r in df.select(cols["replacement_rate"], cols["risk_level"]).collect()]
    assert got == [(50, "MEDIUM"), (34, "MEDIUM")]


def test_trend_in_local_time(spark):
    rows = [(1, datetime(2026, 4, 5, 16, 30), 40), (1, datetime(2026, 4, 6, 15, 0), 41), (1, datetime(2026, 4, 5, 15, 0), None), (1, datetime(2026, 3, 31, 17), 60)]
    df = spark.createDataFrame(rows, "role_id int, snapshot_at timestamp, rate int")
    got = {(r.grain, r.bucket): (r.average_rate, r.points) for r in trend(df).collect()}
    assert got == {("week", "2026-04-06"): (41, 2), ("week", "2026-03-30"): (60, 1), ("month", "2026-04"): (47, 3)}


def test_placeholder_gives_way_only_with_rows(spark):
    df = spark.createDataFrame([("This role is being tracked with 0 recent source signals", 1), ("This role is being tracked with 0 recent source signals", 0), (None, 2)], "s string, n int")
    got = [r[0] for r in df.select(presentation.resolved_summary(F.col("s"), F.col("n"), "en")).collect()]
    assert got[0].startswith("This role is currently tracked with 1 timeline item plus") and got[1].startswith("This role is being") and got[2] is None
