"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some positions of a stretch of tokens and ignores the others. Two texts that agree at all places of
a mask share its hash even if an ignored token was replaced. Hashes of the benchmark and of the documents
meet in a join, and the tokens around each hit are compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bind import bind

#: Tokens of the least overlap, and how many of them must agree; shorter items must agree as a whole.
LEAST, AGREE = 13, 11
#: Masks of the same span; any LEAST tokens with two replaced ones hold a hit of one of them (a test tries all).
MASKS = ("10001110101", "11110100001", "10100010111")
SPAN = len(MASKS[0])
#: Where, from a hit's start, the first of LEAST tokens around it can stand.
FROM = SPAN - LEAST
#: Most benchmark tokens whose seeds are sent to every task (a seed of three numbers for each mask); beyond it hits are
#: found by a shuffle.
BROADCAST_TOKENS = 250_000
WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits) of a text; null counts as empty."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed(h: Column, at: Column, number: int, mask: str) -> Column:
    """Hash of the tokens at the places of a mask; null where the mask reaches over the end."""
    picked = [F.get(h, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(number), *picked))


def seeds(df: DataFrame, masks: Sequence[tuple[int, str]], *keep: str) -> DataFrame:
    """One row for each start and mask of the token arrays ``h``: kept columns, ``at`` and ``key``."""
    at = df.select(*keep, F.posexplode("h").alias("at", "_"))
    made = F.array(*[seed(F.col("h"), F.col("at"), n, m) for n, m in masks])
    return at.select(*keep, "at", F.explode(made).alias("key")).filter("key is not null")


def agreement(h: Callable[[int], Column], b: Callable[[int], Column]) -> Column:
    """Which tokens from FROM before a hit's start agree on its diagonal, a bit for each; none does outside of a text.

    ``h`` and ``b`` give the token at a distance from the hit's start in the text and in the item. Plain comparisons, which Spark
    compiles into the loop that makes the hits: rows of hits with their whole texts would be held until a text is done.
    """
    bits = [F.when(h(i) == b(i), 1 << (i - FROM)).otherwise(0) for i in range(FROM, LEAST)]
    return reduce(lambda x, y: x + y, bits)


def overlap(same: Column, tokens_h: Column, tokens_b: Column, at: Column, at_item: Column) -> Column:
    """Whether on the hit's diagonal some LEAST tokens around the hit agree in AGREE places (``same`` by ``agreement``).

    Items shorter than LEAST must agree as a whole, except for one token of at least SPAN.
    """
    long = reduce(lambda x, y: x | y, [
        (at + lo >= 0) & (at_item + lo >= 0) & (at + lo + LEAST <= tokens_h) & (at_item + lo + LEAST <= tokens_b)
        & (F.bit_count(same.bitwiseAND(F.lit(((1 << LEAST) - 1) << (lo - FROM)))) >= AGREE) for lo in range(FROM, 1)])
    need = F.when(tokens_b >= SPAN, tokens_b - 1).otherwise(tokens_b)
    shift = lambda x, n: F.call_function("shiftleft", x, n)
    inside = shift(shift(F.lit(1), tokens_b) - 1, -at_item - FROM)  # a short item's seeds lie within its first two tokens
    whole = (at >= at_item) & (at - at_item + tokens_b <= tokens_h) & (F.bit_count(same.bitwiseAND(inside)) >= need)
    return F.when(tokens_b >= LEAST, long).otherwise(whole)


def contaminated(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item, hits, first_token): documents that hold LEAST tokens of an item, up to two of them replaced.

    Texts are taken whole. Null and empty texts and items overlap with nothing; items shorter than the masks must
    occur whole and unchanged; repeated rows and items give their pair once (``hits`` counts verified hits of all of
    them); rows with null keys give a pair with a null key, items with null keys give none; empty tables give no rows; further columns are ignored.
    """
    bench = bind(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("_t")), h=tokens(F.col("_t")))
    bench = bench.select("item", "h").filter(F.size("h") > 0)
    size = F.size("h")
    facts = bench.agg(F.coalesce(F.sum(size), F.lit(0)), F.collect_set(F.when(size < SPAN, size))).first()
    whole = [(len(MASKS) + n, "1" * n) for n in sorted(facts[1])]
    short = bench.filter(size < SPAN)
    b_seeds = seeds(bench.filter(size >= SPAN), list(enumerate(MASKS)), "item", "h")
    for n, mask in whole:
        b_seeds = b_seeds.unionByName(seeds(short.filter(size == len(mask)), [(n, mask)], "item", "h"))
    b_seeds = b_seeds.select("item", F.col("at").alias("at_item"), "key").distinct()
    b_items = bench.select("item", F.col("h").alias("b"), F.xxhash64("h").alias("_bh")).dropDuplicates(["item", "_bh"])
    d = bind(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), h=tokens(F.col("_t"))).select("_k", "h")
    masks = [*enumerate(MASKS), *whole]
    at, at_item = F.col("at"), F.col("at_item")
    if facts[0] <= BROADCAST_TOKENS:
        hits = seeds(d, masks, "_k", "h").join(F.broadcast(b_seeds), "key")
        both = hits.join(F.broadcast(b_items), "item").withColumn("tokens", F.size("h"))
        around = lambda i: F.get("h", at + i)
    else:  # slim rows meet by hash; only documents with a hit are read again, and the tokens around a hit go on
        slim = seeds(d, masks, "_k", "h").select("_k", "at", "key").hint("merge").join(b_seeds, "key").distinct()
        again = d.withColumnRenamed("_k", "_k2")
        some = slim.join(again, F.col("_k").eqNullSafe(F.col("_k2"))).select(
            "_k", "item", "at", "at_item", F.size("h").alias("tokens"), F.array(*[
                F.get("h", at + i) for i in range(FROM, LEAST)]).alias("around"))
        both = some.join(b_items, "item")
        around = lambda i: F.get("around", F.lit(i - FROM))
    both = bind(both, same=agreement(around, lambda i: F.get("b", at_item + i)))
    found = both.filter(overlap(F.col("same"), F.col("tokens"), F.size("b"), at, at_item))
    return found.groupBy(F.col("_k").alias(key), F.col("item").alias(item_key)).agg(
        F.count("*").alias("hits"), F.min("at").cast("long").alias("first_token"))
