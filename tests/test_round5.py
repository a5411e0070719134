"""Round 5: texts of items are looked at once, with the same results as plain versions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import matching as mt
from tidemark.plans import classify as cl

BLANKS = "[\\s\x0b\xa0  -     　﻿]"
TEXTS = [
    None, "", " ", "   ", "a", " a ", "a b", "a  b", "a \t b", "a\tb", "\ta\n\n b \r\n", "a\xa0b", "a \xa0 b　", "﻿ a", "é  ü ü",
    "a\x0bb  c d   e", "​ x", "a\x85b", "a\x1cb", "  \n" * 50 + "x" + " " * 300, "~ ! \x7f  \x80",
]


def test_white_space_collapses_as_by_a_plain_pattern(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = dict(df.select("i", text.collapse_space(F.col("t"))).collect())
    for i, t in enumerate(TEXTS):
        plain = None if t is None else re.sub(BLANKS.replace("\\s", " \t\n\x0b\f\r") + "+", " ", t).strip(" ")
        assert got[i] == plain, (i, t)


def test_terms_are_found_as_whole_words(spark):
    terms = ("data center", "award", "awards", "gpu")
    texts = ["GPU", "a gpu.", "gpus", "_gpu", "Data  center", "DATA CENTER", "x awards", "rewards", "award9", "é award ü", "", "AWARD"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.rlike("t", F.lit(text.term_pattern(terms)))).collect()]
    assert got == [re.search(r"(?i)(?<![A-Za-z0-9_])(?:data center|awards|award|gpu)(?![A-Za-z0-9_])", t) is not None for t in texts]
    assert text.term_pattern(["a?b", "c"]).startswith("(?i)(?<!")  # a term that is a pattern gets no look ahead


ITEM = "item_id long, source_catalog_id string, source_url string, source_type string, title string, summary string, hint_text string, hints array<string>"
ITEMS = [
    (1, "s", "u1", "NEWS", "Cold Plate, cold", "a ring and a bolt", "hot ring", ["hot", "ring"]),
    (2, "s", "u2", "NEWS", None, "a ring", "cold plate", ["cold  plate"]),
    (3, "s", "u3", "NEWS", "x", None, None, None),
    (4, "s", "u4", "JOB_POSTING", "bolt " * 40, "", "plate", []),
]
PHRASES = {"r1": ["cold plate", "plate", "cold"], "r2": ["hot ring", "ring", "bolt", "a ring", "and a", "cold", "x", "hot"], "r3": ["zebra"]}


def tables(spark):
    lex = spark.createDataFrame([(s, p, i, p) for s, ps in PHRASES.items() for i, p in enumerate(ps)],
                                "slug string, phrase string, position int, normal string")
    listed = spark.createDataFrame([(i, r, s, 1.0) for i in (1, 2, 3, 4) for r, s in enumerate(PHRASES, 1)],
                                   "item_id long, candidate_rank int, slug string, score double")
    return spark.createDataFrame(ITEMS, ITEM), listed, lex


def folded(t):
    return None if t is None else " ".join(re.findall("[a-z0-9]+", t.lower()))


def test_matched_phrases_of_candidates_equal_a_plain_search(spark):
    items, listed, lex = tables(spark)
    rows = {r["item_id"]: {c["slug"]: c["matched"] for c in r["candidates"]} for r in cl.with_candidates(items, listed, lex).collect()}
    for item, _, _, _, title, summary, _, hints in ITEMS:
        t, s, h = folded(title), folded(summary), folded(None if hints is None else " ".join(hints))
        for slug, phrases in PHRASES.items():
            held = [[None if x is None else p in x for x in (t, s, h)] for p in phrases]
            near = [p for p, (a, b, _) in zip(phrases, held) if a or b]
            # an unknown title or summary tells nothing, so hints count only where both are known
            late = [p for p, (a, b, c) in zip(phrases, held) if a is False and b is False and c]
            assert rows[item][slug] == (near + late)[:6], (item, slug)


def test_scores_count_each_word_and_phrase_once(spark):
    items, _, lex = tables(spark)
    got = {(r["item_id"], r["slug"]): (r["score"], r["matched"]) for r in mt.candidate_scores(items, lex).collect()}
    from tidemark import rules

    for item, _, _, _, title, summary, hint, _ in ITEMS:
        t, s, h = (folded(x) or "" for x in (title, summary, hint))
        words = {w for x in (t, s, h) for w in x.split() if len(w) > 2 and w not in rules.STOP_WORDS}
        for slug, phrases in PHRASES.items():
            score = matched = 0
            for p in phrases:
                a, b, c = p in t, p in s, p in h
                score += rules.POINTS_TITLE * a + rules.POINTS_SUMMARY * b + rules.POINTS_HINT * c + rules.POINTS_MATCHED * (a or b)
                matched += a or b or c
            score += rules.POINTS_TOKEN * len(words & {w for p in phrases for w in p.split()})
            assert got.get((item, slug), (0, 0)) == (score, min(6, matched)), (item, slug)


def test_texts_of_an_item_are_collapsed_once_for_all_models(spark):
    items, _, _ = tables(spark)
    hashed = cl.with_input_hashes(items.withColumn("candidate_slugs", F.array(F.lit("r1"))), ["m1", "m2", "m3"])
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3
    assert all(len(set(r["input_hashes"])) == 3 for r in hashed.collect())


def test_no_list_of_words_leaves_the_engine_for_matching(spark):
    items, _, _ = tables(spark)
    assert mt._folded(items).columns == ["item_id", "_title", "_summary", "_hint"]


def test_languages_are_told_for_a_few_texts_at_a_time():
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructType

    from tidemark.llm import langid

    class Docs:
        columns = ["doc_id", "text"]
        schema = StructType().add("doc_id", LongType()).add("text", StringType())

        def mapInArrow(self, run, schema):  # noqa: N802
            return list(run(iter([batch, batch.slice(0, 0)])))

    n = 3 * langid.TEXTS
    texts = [None if i % 7 == 0 else "12 %" if i % 5 == 0 else f"the house number {i} " * (i % 9) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    net = langid.Network.fresh(["de", "en"], langid.HIDDEN, 1)
    out = langid.predict(Docs(), "text", net)
    letters = [sum(any(map(str.isalpha, t or "")) for t in b.column(1).to_pylist()) for b in out]
    assert len(out) > 1 and letters[:-1] == [langid.TEXTS] * (len(out) - 1) and 0 <= letters[-1] <= langid.TEXTS
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in rows] == list(enumerate(texts))
    for r in rows:
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            p = langid.pooled(net, [r["text"]])[0]
            assert r["lang_pred"] == net.labels[int(np.argmax(p))] and abs(r["score"] - p.max()) < 1e-5


def test_card_patterns_do_not_contend_and_keep_their_matches(spark):
    """Either-or classes and negated ranges made parallel tasks contend; titles compiled a pattern for each row."""
    import inspect

    from tidemark.functions import html, text, urls
    from tidemark.sources import feeds, pages

    for module in (html, feeds, pages, text, urls):
        source = inspect.getsource(module)
        assert r"[\s\S]" not in source and "[^ -~]" not in source and "[^\\\\x21" not in source
    assert "F.split" not in inspect.getsource(html.clean_title)

    rows = [("A  b \t Tag: x\ny", "A b"), ("　Tag: x", ""), ("no tag:x  here", "no tag:x here"), ("Tag: first", "Tag: first"),
            ("a\nTAG:\n", "a"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, want string")
    assert df.select(html.clean_title(F.col("t")).alias("got"), "want").filter("not got <=> want").count() == 0

    dates = [("on March 3, 2024 x", "March 3, 2024"), ("xMarch 3, 2024", None), ("_2024-03-01", None), ("éMarch 3, 2024", "March 3, 2024"),
             ("2024-03-01T10:00Z.", "2024-03-01T10:00Z"), ("March 3, 20245", None), ("12024-03-01", None)]
    df = spark.createDataFrame([(t, w) for t, w in dates], "t string, want string")
    assert df.select(html.date_text(F.col("t")).alias("got"), "want").filter("not got <=> want").count() == 0

    page = '<h2>\n<a href="/a/../b c/ü?x=1">A title\nover two lines</a></h2><p>one\ntwo</p><time>2024-01-02</time></body>'
    df = spark.createDataFrame([(1, "https://s.test/l/", page)], "page_id int, base_url string, html string")
    got = pages.heading_cards(df).select("source_url", "title", "published", "summary").collect()
    assert [tuple(r) for r in got] == [("https://s.test/b%20c/%C3%BC?x=1", "A title over two lines", "2024-01-02", "one two")]


def test_pool_of_a_score_is_dealt_by_role_once(spark):
    """Lists and pool sizes come from one pool: two shuffles of evidence, one for each lane."""
    from tidemark.operators.evidence import evidence_pool, scoring_evidence
    from tidemark.plans.refresh import evidence_lists

    rows = [(f"i{n}", f"r{n % 5}", ("NEWS", "COMPANY_UPDATE", "JOB_POSTING")[n % 3], "discovery-x" if n % 4 == 0 else "c",
             ("HIGH", "MEDIUM", "LOW")[n % 3 if n % 5 else 2], "INCREASE", float(n % 10), n, None, "t  t", "s", None) for n in range(400)]
    rows += [("x", None, "NEWS", None, None, None, None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(
        rows, "item_id string, role_slug string, source_type string, source_catalog_id string, relevance string, impact string, "
        "signal_weight double, n int, raw_json string, title string, summary_en string, inference_summary_en string").withColumn(
        "published_at", F.expr("timestamp'2024-01-01' + make_dt_interval(n)")).drop("n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = evidence_lists(df)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        pool = evidence_pool(df)
        sizes = {r.role_slug: r["count"] for r in pool.groupBy("role_slug").count().collect()}
        best = {}
        for r in scoring_evidence(pool).select("role_slug", "evidence_rank", "adjusted_weight").collect():
            best.setdefault(r.role_slug, []).append((r.evidence_rank, r.adjusted_weight))
        got = out.collect()
        assert {r.role_slug: r.pool_size for r in got} == sizes and None in sizes and best
        for r in got:
            told = None if r.evidence is None else [(e.evidence_rank, e.adjusted_weight) for e in r.evidence]
            assert told == (sorted(best[r.role_slug]) if r.role_slug in best else None)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
