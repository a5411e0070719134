"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_SHARE, join_unique, keep


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` (its smallest reachable node) for every node that has a link.

    Each round takes the smallest root among a node's neighbours, then the root's own root; the second step halves
    what is left of long chains. Nodes with more than one in ``HOT_SHARE`` of all links get their roots by a broadcast of
    those few nodes, and roots are joined by frequency, so neither the centre of a star nor a component with a
    third of all nodes is a hot key. Links with a null end count for nothing. Each round is kept in the shared folder, so a lost
    executor repeats one round at most.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    both = keep(pairs.union(pairs.select("b", "a")).filter("a <> b").distinct(), "links")
    roots = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
        "node", F.least("node", "low").alias("root")), "roots")
    degrees = both.groupBy("b").count()
    total = both.count()
    hot = keep(degrees.filter(F.col("count") > max(1, total // HOT_SHARE)).select("b"), "hot-nodes")
    some_hot = hot.limit(1).count()
    while True:
        of = roots.select(F.col("node").alias("b"), "root")
        if some_hot:
            few = F.broadcast(of.join(F.broadcast(hot), "b", "left_semi"))
            met = both.join(F.broadcast(hot), "b", "left_anti").join(of, "b").unionByName(
                both.join(F.broadcast(hot), "b", "left_semi").join(few, "b"))
        else:
            met = both.join(of, "b")
        near = met.groupBy("a").agg(F.min("root").alias("low"))
        lower = roots.join(near, roots["node"] == near["a"]).select(
            "node", "root", F.least("root", "low").alias("new"))
        lower = keep(lower, "roots-lower")
        changed = lower.filter("new < root").select(F.lit(1)).limit(1).count()
        if not changed:
            return roots
        up = lower.filter("new < node").select(F.col("node").alias("new"), F.col("new").alias("up"))
        roots = keep(join_unique(lower.select("node", "new"), up, "new").select(
            "node", F.coalesce("up", "new").alias("root")), "roots")
