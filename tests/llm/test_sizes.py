"""Plans and memory of joins whose rows the planner sizes too low."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, simhash
from tidemark.llm.common import keep


def executed(df):
    """The plan as it ran, after Spark has chosen its joins anew."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def ten_mb(spark):
    """Spark's own bound for tables which it sends to every task."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10MB", "10485760")


def test_exploded_tables_are_not_sent_to_every_task(spark, ten_mb):
    fps = keep(spark.range(300).select(F.col("id").alias("fp")), "fps")
    found = simhash.links(fps)
    assert "BroadcastExchange" not in executed(found) and found.count() > 0
    groups = keep(spark.range(300).select(
        F.col("id").alias("g"), F.lit(100).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i + F.col("id")).alias(
            "prefix")), "groups")
    held = jaccard.shared_entries(groups, 4, 5)
    assert "BroadcastExchange" not in executed(held) and held.count() == 3000 - 2


def stage_of(plan, operator):
    """Number of the compiled loop that an operator of a plan runs in."""
    return re.search(rf"\*\((\d+)\) {operator}", plan)[1]


def test_hits_of_long_texts_are_checked_in_the_loop_that_makes_them(spark):
    """Between two loops all hits of one text are held, each with the whole text."""
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words * 300)), (2, "same " * 2000), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "same " * 200)], "item_id long, text string")
    found = decontaminate.contaminated(docs, "doc_id", "text", items, "item_id", "text")
    plan = executed(found)
    assert stage_of(plan, r"HashAggregate\(keys=\[\w+#\d+L, \w+#\d+L\], functions=\[partial_count") == stage_of(
        plan, r"BroadcastHashJoin \[key")
    masks = len(decontaminate.MASKS)
    # each mask at each place of the text meets each place of the item, but for six in corners without room for 13 tokens
    same = masks * ((2000 - 10) * (200 - 10) - 6)
    passages = masks * 300 * (30 - 10)
    assert {(r["doc_id"], r["item_id"]): (r["hits"], r["first_token"]) for r in found.collect()} == {
        (1, 1): (passages, 0), (2, 2): (same, 0)}


def test_texts_are_not_shuffled_for_their_fingerprints(spark, monkeypatch):
    texts = [f"word{i % 50} and some more of it {i % 50}" for i in range(200)] + [None, ""]
    docs = keep(spark.createDataFrame([(t,) for t in texts], "_t string"), "texts")
    nodes = keep(docs.filter("_t <> ''").select(F.xxhash64("_t").alias("_h")).distinct().withColumn("node", F.col("_h")), "nodes")
    plans, plain = [], simhash.keep
    monkeypatch.setattr(simhash, "keep", lambda df, name: (plans.append(executed(df)), plain(df, name))[1])
    pairs = simhash.seed_pairs(docs, nodes, 5)
    assert "MapInArrow" in plans[0] and "partial_min(fp" in plans[0] and "min(_t" not in plans[0]
    fp = {r["_h"]: simhash.fingerprint(r["_t"], 5) for r in docs.select("_t", F.xxhash64("_t").alias("_h")).collect() if r["_t"]}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert got == {(min(a, b), max(a, b)) for a, b in got} and all((fp[a] ^ fp[b]).bit_count() <= 2 for a, b in got)
