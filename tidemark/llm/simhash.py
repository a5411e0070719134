"""Near-duplicates by SimHash fingerprints, found through a multi-index of segment Hamming balls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.common import join_unique, keep

#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
CHUNK = 65_536
SEGMENTS = 4


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits, each 1 where more than half of the shingles' XXH64 values have it; 0 without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), (ends[words - 1:] if len(tokens) >= words else ends[-1:]).tolist()
    ones, take = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        raw = b"".join([take(line[a:b], seed) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Key and signed 64-bit fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], names=[key, "fp"])

    src = df.select(key, text)
    kind = dict(src.dtypes)[key]
    return src.mapInArrow(run, f"`{key}` {kind}, fp long")


def ball(fp: Column) -> Column:
    """The fingerprint and its variants by one flipped bit, segment by segment."""
    width = 64 // SEGMENTS
    flips = [[1 << (s * width + b) for b in range(width)] for s in range(SEGMENTS)]
    signed = [0, *(m - (1 << 64) if m >= 1 << 63 else m for segment in flips for m in segment)]
    return F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in signed])


def links(fps: DataFrame) -> DataFrame:
    """Pairs (fp, other) within two bits which connect all fingerprints that lie within two bits.

    Two fingerprints differ by at most two bits exactly if the ball of one bit around each has an entry in
    common, whichever segments the bits lie in. Every distinct fingerprint writes the ball of each segment, with
    the other segments beside it, into the table. An entry is held by at most 65 fingerprints, however large
    a group of near copies is, and each of them is linked to the smallest, so no entry emits all its pairs; the
    full distance of each link is verified. The join names its kind: the planner takes the table for as small as the fingerprints,
    a 65th of its size, and would send it to every task.
    """
    entry = fps.select("fp", F.explode(ball(F.col("fp"))).alias("entry")).hint("merge")
    least = entry.groupBy("entry").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    found = entry.join(least.select("entry", "low"), "entry").filter("fp <> low").select("fp", F.col("low").alias("other"))
    return found.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2).distinct()


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """Fingerprint and component (smallest key reachable over links of at most two bits) of every row.

    Rows of one fingerprint are one node, so copies are never paired. Null and empty texts have fingerprint zero and
    are linked like any other; repeated rows stay; rows with a null key get the smallest non-null key of their
    component, or null where there is none; an empty table gives no rows; further columns are ignored.
    """
    rows = keep(fingerprints(df.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k", "_t", words), "fingerprints")
    nodes = keep(rows.groupBy("fp").agg(F.min("_k").alias("first")), "fingerprint-nodes")
    joined = components(links(nodes.select("fp")), "fp", "other")
    groups = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    groups = keep(groups, "fingerprint-groups")
    smallest = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    named = join_unique(groups.select("fp", "root"), smallest, "root").select("fp", "component_id")
    return join_unique(rows, named, "fp").select(F.col("_k").alias(key), "fp", "component_id")


def seed_pairs(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Links (a, b) of nodes because fingerprints of their texts differ by two bits at most.

    ``docs``: ``_t`` (texts); ``nodes``: node, ``_h`` (hash of one of its texts). Equal fingerprints are linked to their first
    node, close ones through those, so a large group of near copies gives a few pairs for each node. Texts stay in the task that reads them.
    """
    texts = docs.select(F.xxhash64("_t").alias("_h"), "_t")
    fps = fingerprints(texts, "_h", "_t", words).groupBy("_h").agg(F.min("fp").alias("fp"))  # copies of a text have one
    named = keep(nodes.select("node", "_h").join(fps, "_h").select("node", "fp"), "node-fingerprints")
    first = keep(named.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-nodes")
    equal = join_unique(named, first, "fp", "inner").select(F.col("node").alias("a"), F.col("first").alias("b"))
    close = links(first.select("fp")).join(first.withColumnRenamed("first", "a"), "fp").join(
        first.select(F.col("fp").alias("other"), F.col("first").alias("b")), "other").select("a", "b")
    both = equal.unionByName(close).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
