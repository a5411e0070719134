"""Near copies by exact Jaccard similarity of word shingles: a grouped prefix join.

Shingles are ordered from rare to common over the whole corpus. Two similar sets have their first common shingle early in
both, so only short prefixes meet. Documents with the same prefix and size form one group; groups meet by the
shingles of their prefixes, pairs of groups are filtered by size and place, and only members of what is left are
verified by their whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_unique, keep, sent_if_bounded
from tidemark.llm.components import components

#: Counters that tell common shingles from rare ones; the order decides how many pairs are tried, never the result.
BUCKETS = 1 << 20
#: Shingles which leave a task together.
SLICE = 1 << 18
#: 64-bit pieces of the sketch of a prefix.
PIECES = 8
#: Rounds in which each group meets one other group of its entries before all groups meet that are not joined yet.
ROUNDS = 2
#: Pairs of one set which are verified in one task; a set with more goes to several tasks.
VERIFIED = 2048


def _letter_values() -> np.ndarray:
    """A 64-bit value for each byte, A to Z with those of a to z."""
    values = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
    values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


LETTERS = _letter_values()
SOLID = np.array([bytes([b]).strip() != b"" for b in range(256)])
#: Base of the words' polynomials and its inverse: 5 modulo 8, so that few powers are alike in their low bits.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


class WordHashes:
    """Hashes of a text's words: sums of letter values times powers of a base, from one running sum over the text."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def place(self, i: int) -> np.uint64:
        """An odd factor for the word at this place of a shingle."""
        return np.uint64(pow(0xC2B2AE3D27D4EB4F, 2 * i + 1, 1 << 64))

    def of(self, raw: bytes) -> np.ndarray:
        letters = np.frombuffer(raw, np.uint8)
        if len(letters) > len(self.up):
            size = max(1 << 12, 1 << len(letters).bit_length())
            self.up, self.down = (np.multiply.accumulate(np.full(size, b, np.uint64)) for b in (BASE, UNBASE))
        solid = np.zeros(len(letters) + 2, np.int8)
        solid[1:-1] = SOLID[letters]
        edges = np.flatnonzero(np.diff(solid))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(LETTERS[letters] * self.up[:len(letters)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, one without words none."""
    h = known.of((text or "").encode("utf-8", "replace"))
    if not len(h):
        return np.empty(0, np.int64)
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i:i + n] * known.place(i)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    out = (out ^ (out >> np.uint64(31))).view(np.int64)
    out.sort()
    first = np.ones(n, np.bool_)
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]


def name_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), 1) - (1 << 63)


def bucket(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) >> np.uint64(44)).astype(np.int64)


def sketch(prefix: np.ndarray) -> np.ndarray:
    """For each of 64 * PIECES classes of shingles whether the prefix has an odd number of them."""
    odd = np.bincount((prefix.view(np.uint64) % np.uint64(64 * PIECES)).astype(np.int64), minlength=64 * PIECES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def rarity(docs: DataFrame, words: int) -> np.ndarray:
    """How many sets of the corpus have a shingle of each bucket: a bounded number of counters over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(BUCKETS, np.int64), WordHashes()
        for batch in batches:
            for t in batch.column(0):
                np.add.at(counts, bucket(shingles(t.as_py(), words, known)), 1)
        at = np.flatnonzero(counts).astype(np.int32)
        for i in range(0, len(at), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + SLICE]), pa.array(counts[at[i:i + SLICE]])], names=["at", "n"])

    seen = docs.select("_t").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[seen["at"].to_numpy()] = seen["n"].to_numpy()
    return counts


def prefixes(docs: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """Key, hash of the text, node (name of the shingle set), its size, and its first shingles by (how common, hash)."""
    counts = docs.sparkSession.sparkContext.broadcast(rarity(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        common = counts.value

        def out(batch: pa.RecordBatch, at: int, nodes: list, sizes: list, firsts: list) -> pa.RecordBatch:
            offsets = np.cumsum([0] + [len(f) for f in firsts]).astype(np.int32)
            pieces = pa.array(np.concatenate([sketch(f) for f in firsts]))
            every = pa.array(np.arange(0, PIECES * len(firsts) + 1, PIECES, dtype=np.int32))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(nodes)), batch.column(1).slice(at, len(nodes)), pa.array(nodes, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts))),
                 pa.ListArray.from_arrays(every, pieces)], names=["_k", "_h", "node", "n", "prefix", "sketch"])

        for batch in batches:
            at, held, nodes, sizes, firsts = 0, 0, [], [], []
            for i, t in enumerate(batch.column(2)):
                found = shingles(t.as_py(), words, known)
                n = len(found)
                take = n - -(-n * over // under) + 1 if n else 0
                order = np.lexsort((found, common[bucket(found)]))[:take]
                nodes.append(name_of(found))
                sizes.append(n)
                firsts.append(found[order])
                held += take
                if held > SLICE:
                    yield out(batch, at, nodes, sizes, firsts)
                    at, held, nodes, sizes, firsts = i + 1, 0, [], [], []
            if nodes:
                yield out(batch, at, nodes, sizes, firsts)

    src = docs.select("_k", F.xxhash64("_t").alias("_h"), "_t")
    return src.mapInArrow(run, f"_k {dict(src.dtypes)['_k']}, _h long, node long, n int, prefix array<long>, sketch array<long>")


def set_rows(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """Node and shingle set of every wanted node (node, hash of one of its texts), once; other texts are not taken apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def out(sets: list) -> pa.RecordBatch:
            offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([name_of(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["node", "set"])

        done: set[int] = set()  # copies of a text in one task are taken apart once
        for batch in batches:
            sets, held = [], 0
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h in done:
                    continue
                if len(done) < SLICE:
                    done.add(h)
                sets.append(shingles(t.as_py(), words, known))
                held += len(sets[-1])
                if held > SLICE:
                    yield out(sets)
                    sets, held = [], 0
            if sets:
                yield out(sets)

    texts = docs.select(F.xxhash64("_t").alias("_h"), "_t").join(
        sent_if_bounded(wanted.select("_h").distinct()), "_h", "left_semi")
    return texts.select("_h", "_t").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity, by their whole sets.

    A set of many pairs is sent to as many tasks as its pairs need, so no key is hot and no set goes everywhere.
    """
    pairs = keep(pairs, "tried-pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = keep(set_rows(docs, words, nodes.join(sent_if_bounded(ids), "node", "left_semi")), "tried-sets")
    for side, name in (("a", "x"), ("b", "y")):
        many = pairs.groupBy(side).agg(F.count("*").alias("_c")).filter(F.col("_c") > VERIFIED).select(
            side, (F.col("_c") / VERIFIED + 1).cast("int").alias("_parts"))
        many = keep(many, "many-pairs")
        put = pairs.join(sent_if_bounded(many), side, "left").withColumn(
            "_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a", "b"), F.col("_parts")).cast("int"))).drop("_parts")
        copies = sets.select(F.col("node").alias(side), F.col("set").alias(name)).join(sent_if_bounded(many), side, "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
        pairs = put.join(copies, [side, "_part"]).drop("_part")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.withColumn("_both", both).filter(
        F.col("_both") * under >= over * (F.size("x") + F.size("y") - F.col("_both"))).select("a", "b")


def needed(a: Column, b: Column, over: int, under: int) -> Column:
    """Least common shingles of two similar sets of these sizes: c / (a + b - c) >= over / under."""
    return F.ceil(F.lit(over) * (a + b) / F.lit(over + under))


def reachable(x: str, y: str, over: int, under: int) -> Column:
    """Whether two groups can hold similar sets, by all their prefix shingles.

    Of the two prefixes one ends first in the order of all shingles. What is common up to that end stands in both prefixes,
    and what is common behind it is among the shingles left of that set.
    """
    n, m, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.prefix"), F.col(f"{y}.prefix")
    both = F.size(F.array_intersect(px, py))
    left = F.greatest(n - F.size(px), m - F.size(py))
    return both + left >= needed(n, m, over, under)


def prefix_size(n: Column, over: int, under: int) -> Column:
    return n - F.ceil(F.lit(over) * n / F.lit(under)) + 1


def sketched(x: str, y: str, over: int, under: int) -> Column:
    """``reachable`` by the sketches of the prefixes: where they differ, the prefixes differ in one shingle at least."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    a, b = prefix_size(n, over, under), prefix_size(m, over, under)
    differ = sum((F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(PIECES)), F.lit(0))
    return F.floor((a + b - differ) / 2) + F.greatest(n - a, m - b) >= needed(n, m, over, under)


def shared_entries(groups: DataFrame, over: int, under: int) -> DataFrame:
    """(entry, g, n, at, held, early) of prefix shingles which several groups hold (``held``: how many).

    Of two similar sets the smaller has its first common shingle in a still shorter prefix; entries which stand in no
    such prefix are not ``early`` and join nothing. The join names its kind: the planner sizes the entries as one a group and
    would send them to every task.
    """
    rows = groups.select("g", "n", F.posexplode("prefix").alias("at", "entry")).hint("merge")
    early = F.col("at") <= F.col("n") - F.ceil(F.lit(2 * over) * F.col("n") / F.lit(over + under))
    useful = rows.groupBy("entry").agg(F.count("*").alias("held"), F.max(early).alias("_e")).filter("held > 1")
    return rows.join(useful, "entry").select("entry", "g", "n", "at", "held", F.col("_e").alias("early"))


def with_roots(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df.withColumn("root", F.col("node"))
    return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def hubs(held: DataFrame, over: int, under: int) -> DataFrame:
    """(g, hub) of groups: the logarithm of how many groups hold a shingle, on average over the prefix.

    A copy with few words of its own is near to more of the others than one with many.
    """
    return held.groupBy("g").agg((F.sum(F.log2("held")) / F.first(prefix_size(F.col("n"), over, under))).alias("hub"))


def pairs_of(shared: DataFrame, members: DataFrame, groups: DataFrame, turn: int, over: int, under: int,
             hub: DataFrame | None = None) -> DataFrame:
    """Each group meets one other group of each of its entries; its members try the one met most often.

    With ``hub`` that is the entry's greatest hub, so most of a group of near copies is joined at once and few of its pairs
    are left; other turns pick anew by chance.
    """
    heads = members.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                     F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("head"))
    chance = F.xxhash64("g", "entry", F.lit(turn))
    now = shared.join(heads.select("g", "low", "high"), "g")
    if hub is not None:
        now, chance = now.join(hub, "g"), F.struct(-F.col("hub"), F.xxhash64("g"))
    centre = now.groupBy("entry").agg(F.min_by(F.struct("g", "n", "at", "low", "high"), chance).alias("c"))
    met = now.alias("x").join(centre.select("entry", "c.*").alias("y"), "entry").filter(
        (F.col("x.g") != F.col("y.g")) & ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
        & (F.least("x.at", "y.at") + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
           >= needed(F.col("x.n"), F.col("y.n"), over, under)))
    often = met.groupBy(F.col("x.g").alias("g"), F.col("y.g").alias("other")).agg(F.count("*").alias("often"))
    best = keep(often.groupBy("g").agg(F.max_by("other", F.struct("often", "other")).alias("other")), "group-best")
    whole = groups.select("g", F.struct("n", "prefix").alias("x"))
    best = best.join(whole, "g").join(whole.select(F.col("g").alias("other"), F.col("x").alias("y")), "other").filter(
        reachable("x", "y", over, under)).select("g", "other")
    # members of a group also meet its head
    meets = best.unionByName(heads.filter("low < high").select("g", F.col("g").alias("other")))
    to = join_unique(keep(meets, "group-meets"), heads.select(F.col("g").alias("other"), F.col("head")), "other", "inner").select("g", "head")
    tried = members.select("g", "node", "root").join(to, "g").join(
        members.select(F.col("node").alias("head"), F.col("root").alias("to")), "head").filter(F.col("root") != F.col("to"))
    return tried.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def pairs_left(shared: DataFrame, members: DataFrame, groups: DataFrame, over: int, under: int) -> DataFrame:
    """All pairs of sets that may be similar and are not in one component yet.

    Places of an entry (size and position) meet before groups do: a place pair that cannot hold a first common shingle
    of similar sets, or holds one component only, names no groups. Groups of the places left meet if the sketches of
    their prefixes, and then the prefixes themselves, leave room for similar sets.
    """
    roots = members.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    now = keep(shared.join(roots, "g"), "entries-left")
    places = now.groupBy("entry", "n", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    x, y = places.alias("x"), places.alias("y")
    open_ = x.join(y, "entry").filter(
        (F.struct("x.n", "x.at") <= F.struct("y.n", "y.at"))
        & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= needed(F.col("x.n"), F.col("y.n"), over, under))
        & (F.least("x.low", "y.low") < F.greatest("x.high", "y.high"))).select(
        "entry", F.col("x.n").alias("n"), F.col("x.at").alias("at"), F.col("y.n").alias("n2"), F.col("y.at").alias("at2"))
    open_ = keep(open_, "places-left")
    named = open_.select("entry", "n", "at").union(open_.select("entry", "n2", "at2")).distinct()
    rows = keep(now.join(named, ["entry", "n", "at"], "left_semi").join(groups.select("g", "sketch"), "g").select(
        "entry", "n", "at", F.struct("g", "n", "low", "high", "sketch").alias("x")), "open-entries")
    one = open_.join(rows, ["entry", "n", "at"]).select(
        "entry", F.col("n2").alias("n"), F.col("at2").alias("at"), F.col("x").alias("y"))
    met = one.join(rows, ["entry", "n", "at"]).filter(
        (F.col("x.g") != F.col("y.g")) & (F.least("x.low", "y.low") < F.greatest("x.high", "y.high"))
        & sketched("x", "y", over, under)).select(
        F.least("x.g", "y.g").alias("g1"), F.greatest("x.g", "y.g").alias("g2")).distinct()
    whole = groups.select("g", F.struct("n", "prefix").alias("x"))
    two = keep(met, "group-pairs").join(whole.withColumnRenamed("g", "g1"), "g1").join(
        whole.toDF("g2", "y"), "g2").filter(reachable("x", "y", over, under)).select("g1", "g2")
    inside = roots.filter("low < high").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    m = members.select("g", "node", "root")
    both = two.unionByName(inside).join(m.toDF("g1", "a", "r1"), "g1").join(m.toDF("g2", "b", "r2"), "g2")
    return both.filter("r1 <> r2 and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(df: DataFrame, key: str, text: str, words: int = 5, over: int = 4, under: int = 5,
                seeds: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, empty: bool = False) -> DataFrame:
    """Key, ``n_shingles`` and component (smallest key reachable over pairs of similarity >= over / under) of every row.

    Words are lower-cased (A to Z); a text of fewer words is one shingle. Every similar pair has a common entry, and is
    left out only where both sets are in one component already: a large group of near copies is joined by a
    few pairs of each set. ``seeds`` may name further links (a, b) of nodes by another measure, which are joined first: it gets the
    documents (``_t``), the nodes (``node``, ``_h``) and the number of words. Null and empty texts and texts without words have no shingle and are linked with nothing, or with ``empty`` with each other; repeated rows stay; rows with a
    null key get the smallest non-null key of their component, or null; an empty table gives no rows; further columns are ignored.
    """
    docs = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = keep(prefixes(docs, words, over, under), "shingle-prefixes")
    some = rows.filter("n > 0")
    nodes = keep(some.withColumn("g", F.xxhash64("n", "prefix")).groupBy("node").agg(
        F.min("g").alias("g"), F.min("_h").alias("_h"), F.min("_k").alias("first")), "shingle-nodes")
    groups = keep(some.withColumn("g", F.xxhash64("n", "prefix")).dropDuplicates(["g"]).select("g", "n", "prefix", "sketch"), "shingle-groups")
    held = keep(shared_entries(groups, over, under), "shared-entries")
    shared = held.filter("early").select("entry", "g", "n", "at")
    links, roots = None, None
    for turn in range(-1 if seeds else 0, ROUNDS + 1):
        if turn < 0:
            found = keep(seeds(docs, nodes, words), "seed-links")
        else:
            members = keep(with_roots(nodes.select("node", "g"), roots), "group-members")
            hub = None if turn else hubs(held, over, under)
            pairs = (pairs_of(shared, members, groups, turn, over, under, hub) if turn < ROUNDS
                     else pairs_left(shared, members, groups, over, under))
            found = keep(verified(docs, pairs, nodes, words, over, under), "similar-pairs")
        links = found if links is None else links.unionByName(found)
        roots = components(links, "a", "b")
    first = nodes.select("node", "first")
    if empty:
        first = first.unionByName(rows.filter("n = 0").groupBy("node").agg(F.min("_k").alias("first")))
    joined = keep(with_roots(first, roots), "similar-groups")
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = join_unique(joined.select("node", "root"), smallest, "root").select("node", "component_id")
    out = join_unique(rows.select("_k", "node", "n"), named, "node")
    return out.select(F.col("_k").alias(key), F.col("n").cast("long").alias("n_shingles"),
                      F.when((F.col("n") > 0) | F.lit(empty), F.col("component_id")).otherwise(F.col("_k")).alias("component_id"))
