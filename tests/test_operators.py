"""Operators on literal rows, against brute force where that is short."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators import catalogue as cat
from tidemark.operators import matching as mt
from tidemark.operators import state as st
from tidemark.operators.evidence import evidence_pool, scoring_evidence
from tidemark.operators.intake import normalise_fetch
from tidemark.operators.notices import admit_subscriptions
from tidemark.operators.ranking import global_positions, last_value_first_position, top_k
from tidemark.plans import ingest
from tidemark.sources import dictionary, pages


def test_last_value_first_position(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, p int, v string")
    got = {(r.k, r.v, r.first_position) for r in last_value_first_position(df, ["k"], "p").collect()}
    assert got == {("a", "z", 1), ("b", "y", 2)}


def test_top_k_plans_a_limit_below_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_k(df, ["k"], [F.col("id").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_global_positions(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r.v: r.position for r in global_positions(df, [F.col("v").desc()]).collect()}
    assert got == {v: 500 - v for v in values}


def _evidence(rows):
    base = dict(role_slug="r", source_type="COMPANY_UPDATE", source_catalog_id="c", relevance="HIGH", impact="INCREASE", signal_weight=1.0,
                raw_json=None, title="t")
    return [{**base, **r} for r in rows]


EVIDENCE = ("item_id string, role_slug string, source_type string, source_catalog_id string, relevance string, impact string, "
            "signal_weight double, raw_json string, title string, published_at timestamp")


def evidence_frame(spark, rows):
    names = [c.split()[0] for c in EVIDENCE.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVIDENCE)


def test_pool_keeps_older_primary_rows(spark):
    day = datetime(2024, 1, 1)
    rows = _evidence(
        [dict(item_id=f"d{i}", source_catalog_id="discovery-x", published_at=day + timedelta(days=100 + i)) for i in range(10)]
        + [dict(item_id=f"p{i}", published_at=day + timedelta(days=i)) for i in range(10)])
    got = {r.item_id for r in evidence_pool(evidence_frame(spark, rows), recent=4, backstop=3).collect()}
    assert got == {"d9", "d8", "d7", "d6", "p9", "p8", "p7"}


def test_evidence_rules(spark):
    day = datetime(2024, 1, 1)
    rows = _evidence([
        dict(item_id="keep", published_at=day),
        dict(item_id="media-tooling", source_type="NEWS", published_at=day),
        dict(item_id="veto", raw_json='{"strategyCanAffectReplacementRate": false}', published_at=day),
        dict(item_id="weak-job", source_type="JOB_POSTING", signal_weight=0.29, published_at=day),
        dict(item_id="low-media", source_type="NEWS", relevance="LOW", raw_json='{"signalType": "ADOPTION"}', published_at=day),
        dict(item_id="media", source_type="NEWS", raw_json='{"signalType": "adoption_case"}', published_at=day),
        dict(item_id="lane", source_type="NEWS", source_catalog_id="discovery-a", signal_weight=0.6, raw_json='{"value": "adoption"}', published_at=day),
    ])
    got = {r.item_id: r.adjusted_weight for r in scoring_evidence(evidence_frame(spark, rows)).collect()}
    assert got == {"keep": 1.0, "media": 0.65, "lane": 0.29}


def test_bad_date_fails_its_source_before_its_keys_count(spark):
    rows = [
        (1, 0, "catalog-0", "https://a.test/1", "t", "s", "2024-01-01"), (2, 0, "catalog-0", "https://a.test/2", "t", "s", "never"),
        (3, 1, "discovery-1", "https://www.a.test/1?utm_x=1", " late ", "s", "2024-01-02"),
        (4, 1, "discovery-1", "https://a.test/1", " last ", "s", "2024-01-03"),
    ]
    raw = spark.createDataFrame(rows, "idx long, source_ord int, source_catalog_id string, source_url string, title string, summary string, published string")
    out = normalise_fetch(raw)
    assert [r.source_ord for r in out.failed_sources.collect()] == [0]
    assert [(r.source_url, r.title) for r in out.items.collect()] == [("https://a.test/1", "last")]


def _brute_related(roles, k):
    out = {}
    for slug, _, _, group, words, _ in roles:
        others = []
        for s2, en, zh, g2, w2, active in roles:
            if active and g2 == group and s2 != slug:
                mine = {w.lower() for w in w2}
                others.append((-sum(w.lower() in mine for w in words), 0 if zh != en else 1, en, s2))
        out[slug] = [o[3] for o in sorted(others)[:k]]
    return out


@pytest.mark.parametrize("width", [4, 20])
def test_related_roles_match_brute_force(spark, width):
    """Narrow and wide keyword lists, with a word that all roles of the wide case hold."""
    rnd = random.Random(7)
    words = ["a", "B", "b", "c", "d", "hot"] if width == 4 else ["hot", *(f"w{i}" for i in range(40))]
    roles = [
        (f"r{i:02d}", f"n{rnd.randint(0, 9)}", f"n{rnd.randint(0, 9)}", rnd.choice(["g", "g", "h"]),
         ["hot"] * (1 if width > 4 else rnd.randint(0, 1)) + [rnd.choice(words) for _ in range(rnd.randint(width // 5, width))], rnd.random() < 0.8)
        for i in range(40)
    ]
    df = spark.createDataFrame(roles, "slug string, name_en string, name_zh string, industry_code string, keywords array<string>, is_active boolean")
    got = {}
    for r in sorted(cat.related_roles(df, 4).collect(), key=lambda r: r.related_rank):
        got.setdefault(r.base_slug, []).append(r.related_slug)
    assert got == {s: v for s, v in _brute_related(roles, 4).items() if v}


def _brute_scores(items, roles):
    import re

    def fold(v):
        return re.sub("[^a-z0-9]+", " ", v.lower()).strip()

    def toks(v):
        return {w for w in fold(v).split(" ") if len(w) > 2 and w not in rules.STOP_WORDS}

    out = {}
    for item, title, summary, hint in items:
        t, s, h = fold(title), fold(summary), fold(hint)
        for slug, phrases in roles.items():
            normal = [fold(p) for p in dict.fromkeys(phrases) if fold(p)]
            near = sum(n in t or n in s for n in normal)
            score = near * 6 + sum(n in t for n in normal) * 5 + sum(n in s for n in normal) * 3 + sum(n in h for n in normal) * 2
            shared = toks(" ".join(phrases)) & toks(f"{t} {s} {h}")
            matched = min(6, sum(n in t or n in s or n in h for n in normal))
            if score + 1.5 * len(shared) > 0:
                out[item, slug] = (score + 1.5 * len(shared), matched)
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 100])
def test_candidate_scores_in_one_and_several_parts(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(mt, "PART_BYTES", part_bytes)
    items = [(1, "Ticket triage at scale", "Support agents close tickets; étude", "support"), (2, "Coding, coding!", "the workflow of a ring", ""),
             (3, "nothing", "here", "ring ops")]
    roles = {"a": ["ticket", "Ticket", "support agent", "中文"], "b": ["ring", "in", "coding"], "c": ["ops the", "workflow of"]}
    df = spark.createDataFrame(items, "item_id int, title string, summary string, hint_text string")
    lex = mt.lexicon(spark.createDataFrame([(s, p) for s, p in roles.items()], "slug string, keywords array<string>"))
    got = {(r.item_id, r.slug): (r.score, r.matched) for r in mt.candidate_scores(df, lex).collect()}
    assert got == {k: v for k, v in _brute_scores(items, roles).items() if v[1]}


def test_best_candidates_with_shared_phrase_sets(spark):
    """Roles with one phrase set share a search; the cut and its tie order must not notice."""
    items = [(1, "NEWS", "ring and bolt", "a plate", ""), (2, "NEWS", "plate", "nothing", "")]
    words = [["ring"], ["bolt", "plate"], ["plate"]]
    roles = {f"r{(i * 7) % 30:02d}": words[i % 3] for i in range(30)}
    df = spark.createDataFrame(items, "item_id int, source_type string, title string, summary string, hint_text string")
    lex = mt.lexicon(spark.createDataFrame(list(roles.items()), "slug string, keywords array<string>"))
    rows = mt.select_candidates(df, lex, keep=12).collect()
    brute = _brute_scores([(i, t, s, h) for i, _, t, s, h in items], roles)
    for item in (1, 2):
        want = sorted(((-score, slug) for (i, slug), (score, _) in brute.items() if i == item))[:12]
        got = [(-r.score, r.slug) for r in sorted(rows, key=lambda r: r.candidate_rank) if r.item_id == item]
        assert got == want


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, n string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", None)], "k int, v string, n string")
    once = st.upsert(old, new, ["k"], keep_if_null=["n"])
    twice = st.upsert(once, new, ["k"], keep_if_null=["n"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)] == sorted(map(tuple, twice.collect()))


def test_watch_limit_counts_known_pairs_first(spark):
    have = spark.createDataFrame([("A@x ", "r1"), ("a@x", "r2")], "email string, slug string")
    asked = spark.createDataFrame([("a@x", "r1", 1), ("a@x", "r3", 2), ("a@x", "r4", 3), ("b@x", "r1", 1)], "email string, slug string, requested_at int")
    got = {(r.email, r.slug): r.outcome for r in admit_subscriptions(have, asked).collect()}
    assert got == {("a@x", "r1"): "known", ("a@x", "r3"): "admitted", ("a@x", "r4"): "refused", ("b@x", "r1"): "admitted"}


def test_import_reduces_repeated_slugs_first(spark):
    old = spark.createDataFrame([("a", "A", True), ("z", "Z", True)], "slug string, name_en string, is_active boolean")
    snap = spark.createDataFrame([("", "one", 1), ("", "two", 2), ("a", "New", 3)], "slug string, name_en string, ordinal int")
    got = {(r.slug, r.name_en, r.is_active) for r in cat.import_dictionary(old, snap).collect()}
    assert got == {("", "two", True), ("a", "New", True), ("z", "Z", False)}


def test_dictionary_from_csv(spark, tmp_path):
    (tmp_path / "roles.csv").write_text('Category\n\n"Clerks, ""Data"" & Entry"\n  Legal Secretaries and Administrative Assistants  \nActors\n', encoding="utf8")
    names = dictionary.read_names(spark, str(tmp_path / "roles.csv"))
    zh = spark.createDataFrame([("Actors", "演员")], "name_en string, name_zh string")
    rows = {r.slug: r for r in dictionary.role_dictionary(names, zh).collect()}
    assert rows["clerks-data-and-entry"].source_code == "csv-role-1" and list(rows["clerks-data-and-entry"].keywords) == ["clerks", "data", "entry"]
    assert rows["legal-secretary-and-administrative-assistant"].source_code == "43-6012"
    assert rows["actors"].name_zh == "演员" and "bookkeeping-clerk" in rows


def test_all_failed_sources_raise(spark):
    items = spark.createDataFrame([("observe_only",)], "mapping_mode string")
    sources = spark.createDataFrame([("a", True)], "source_catalog_id string, failed boolean")
    with pytest.raises(Exception, match="All attempted source fetches failed"):
        ingest.run_totals(items, sources).collect()


def test_fuzzy_search_ladder(spark):
    df = spark.createDataFrame([(s,) for s in ("data clerk", "data clerks", "a data clerk", "clerk of data", "dxaxtxa clerk", "other")], "f string")
    got = {r.f: r.s for r in df.select("f", cat.search_score("data clerk", [F.col("f")]).alias("s")).collect()}
    assert got == {"data clerk": 1000, "data clerks": 900, "a data clerk": 798, "clerk of data": 637, "dxaxtxa clerk": 487, "other": -1}


def test_nested_card_ends_with_its_own_tag(spark):
    page = ('<div class="post-card"><div><div>x</div></div><a href="/1"><h2>First title</h2></a><time>May 1, 2024</time><div class="content">body</div></div>'
            '<div class="post-card"><a href="/2">open')
    df = spark.createDataFrame([(1, "https://s.test/", page)], "page_id int, base_url string, html string")
    got = [(r.source_url, r.title, r.published, r.summary) for r in pages.classed_cards(df).collect()]
    assert got == [("https://s.test/1", "First title", "May 1, 2024", "body")]


def test_search_as_a_join_equals_the_ladder_for_each_query(spark, monkeypatch):
    rnd = random.Random(3)
    names = [(f"r{i}", " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 3)))) for i in range(150)]
    names += [("r900", ""), ("r901", None)]
    df = spark.createDataFrame(names, "slug string, name string").withColumn("other", F.reverse("name"))
    typed = ["", "a", "ab", "abc", "c b", "é a", "bca", "aé c", "zz", "cab  a", "a", None]
    queries = spark.createDataFrame([(q,) for q in typed], "query string")
    monkeypatch.setattr(cat, "QUERY_BLOCK", 4)
    got = {(r["query"], r["slug"], r["score"]) for r in cat.search_join(df, queries, ("name", "other"), "name").collect()}
    plain = sorted({" ".join(q.split()) for q in typed if q is not None})
    expected = {(r["query"], r["slug"], r["score"]) for r in cat.search_names(df, plain, ("name", "other"), "name").collect()}
    assert got == expected and {q for q, _, _ in got} >= {"", "a", "c b"}


def test_search_as_a_join_scores_each_text_once(spark):
    """Names which share texts: scores and first rows are those of the ladder, with a few names of each text scored."""
    rnd = random.Random(4)
    words = ["hot ring", "Hot Ring", "hót ring", "ring hot", "bolt"]
    names = [(f"r{i}", w, f"{w}-x" if i % 3 else w) for i, w in enumerate(rnd.choices(words, k=300))]
    names += [("r7", *names[7][1:]), ("r301", None, "hot ring"), ("r302", "hot ring", None), (None, "hot ring", "bolt")]
    df = spark.createDataFrame(names, "slug string, label string, other string")
    df = df.withColumn("name", F.lower("label")).withColumn("other", F.lower("other"))
    typed = ["", "hot", "hot ring", "ring", "htrg", "bolt-x", "r3", "zz"]
    queries = spark.createDataFrame([(q,) for q in typed], "query string")
    got = [(r["query"], r["slug"], r["label"], r["score"]) for r in cat.search_join(df, queries, ("name", "other", "slug"), "label").collect()]
    expected = [(r["query"], r["slug"], r["label"], r["score"]) for r in cat.search_names(df, typed, ("name", "other", "slug"), "label").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(got) > 40
    plain = df.select(F.monotonically_increasing_id().alias("_id"), F.col("label").alias("_label"), F.col("slug").alias("_slug"),
                      F.array("name", "other", "slug").alias("texts"))
    assert cat._first_holders(plain).groupBy("text").count().agg(F.max("count")).first()[0] == 8
