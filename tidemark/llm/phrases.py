"""Collocations from stripes: each prefix keys a counter of the words that follow it.

Stripes of a task are made in its memory, travel whole and are merged word by word. A merged stripe gives the extensions of
its prefix, which are the totals of the prefixes of the next round, and the largest extension. Prefixes grow by one word a round,
and a word joins a stripe only if both its parts are frequent, which no frequent phrase can miss.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_unique, keep

#: Words whose stripes are made together in a task.
COUNTED = 1 << 20
#: Bits of the filter of frequent phrases. One bit too many costs a few useless counts; a frequent phrase is never missed.
FILTER_BITS = 1 << 25
#: Parts of the stripe of the empty prefix; other stripes are split where a prefix has more than one in this many words.
PARTS = 4096
#: Pieces end at these characters; words are runs of anything else but blank and tab.
TOKEN = rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+"
ENDS = frozenset(b".,;:!?\n\x0b\x0c\r"[i:i + 1] for i in range(10))
UNKNOWN = "und"
STRIPES = "lang string, prefix string, part int, next array<string>, n array<int>"


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + word
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def places(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(33))) % np.uint64(bits)).astype(np.int64)


def member(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = places(h, 8 * len(known))
    return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


class Texts:
    """Word codes of the texts of one language held by a task, with -1 after every piece."""

    def __init__(self, lang: str):
        self.lang = lang
        self.codes: dict[bytes, int] = defaultdict(count().__next__, dict.fromkeys(ENDS, -1))
        self.held: list[np.ndarray] = []

    def add(self, tokens: list[bytes]) -> None:
        self.held.append(np.fromiter(map(self.codes.__getitem__, tokens), np.int32, len(tokens)))
        self.held.append(np.array([-1], np.int32))

    def stripes(self, words: int, known: list[np.ndarray], hot: dict[tuple[str, str], int]) -> pa.RecordBatch | None:
        """Stripes of the frequent prefixes of that many words; ``known`` has the filters of frequent phrases by length."""
        c = np.concatenate(self.held)
        vocabulary = list(self.codes)[len(ENDS):]
        if not vocabulary:
            return None
        names = pa.array(vocabulary, pa.binary()).cast(pa.string())
        if not words:
            return self._rows(np.zeros(len(vocabulary), np.int64), np.arange(len(vocabulary)),
                              np.bincount(c[c >= 0], minlength=len(vocabulary)), [""], names, hot)
        h = word_hashes(vocabulary, self.lang)
        hashes = extended(np.zeros(len(vocabulary), np.uint64), h)
        frequent = member(known[0], hashes)
        # number of the frequent phrase of ``length`` words that starts at each place
        of = np.full(len(c) + 1, -1, np.int64)
        of[:-1] = np.where((c >= 0) & frequent[c], c, -1)
        phrases = np.arange(len(vocabulary))[:, None]
        for length in range(1, words + 1):
            # a phrase of one word more joins two frequent ones that overlap in all but a word
            at = np.flatnonzero((of[:-1] >= 0) & (of[1:] >= 0))
            if not len(at):
                return None
            last = c[at + length]
            both, number = np.unique(of[at] * len(vocabulary) + last, return_inverse=True)
            prefix, after = both // len(vocabulary), both % len(vocabulary)
            if length == words:
                used, prefix = np.unique(prefix, return_inverse=True)
                texts = [b" ".join([vocabulary[w] for w in row]).decode("utf-8", "replace") for row in phrases[used].tolist()]
                return self._rows(prefix, after, np.bincount(number), texts, names, hot)
            phrases = np.column_stack((phrases[prefix], after))
            hashes = extended(hashes[prefix], h[after])
            frequent = member(known[length], hashes)
            of[:] = -1
            good = frequent[number]
            of[at[good]] = number[good]

    def _rows(self, prefix, after, n, texts, names, hot) -> pa.RecordBatch:
        parts = np.array([hot.get((self.lang, t), 1) for t in texts], np.int64)[prefix] if hot else np.ones(len(prefix), np.int64)
        if texts == [""]:
            parts[:] = PARTS
        part = np.zeros(len(prefix), np.int64)
        split = np.flatnonzero(parts > 1)
        if len(split):
            # by the word itself, so that all tasks choose alike
            every = word_hashes([x.encode() for x in names.to_pylist()], "")
            part[split] = (mixed_part(every[after[split]]) % parts[split].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((part, prefix))
            prefix, after, n, part = prefix[order], after[order], n[order], part[order]
        new = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]))))
        offsets = pa.array(np.append(new, len(prefix)).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            pa.array([self.lang] * len(new), pa.string()), pa.array(texts, pa.string()).take(pa.array(prefix[new])),
            pa.array(part[new].astype(np.int32)), pa.ListArray.from_arrays(offsets, names.take(pa.array(after))),
            pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))], names=["lang", "prefix", "part", "next", "n"])


def mixed_part(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)


def stripes(docs: DataFrame, words: int, known: list[np.ndarray], hot: dict[tuple[str, str], int]) -> DataFrame:
    """Stripes of all prefixes of that many words, one or more rows of each prefix and part a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        split = re.compile(TOKEN).findall
        held, n = {}, 0

        def flush():
            for texts in held.values():
                rows = texts.stripes(words, known, hot)
                for at in range(0, rows.num_rows if rows else 0, 20_000):
                    yield rows.slice(at, 20_000)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                tokens = split((text.as_py() or "").encode("utf-8", "replace").lower())
                lang = lang.as_py()
                held.setdefault(lang, Texts(lang)).add(tokens)
                n += len(tokens) + 1
                if n >= COUNTED:
                    yield from flush()
                    held, n = {}, 0
        yield from flush()

    return docs.mapInArrow(run, STRIPES)


def merged(made: DataFrame, least: int) -> DataFrame:
    """Stripes merged word by word: a row for each prefix and part with its total, largest and frequent extensions."""
    key = ["lang", "prefix", "part"]
    dealt = made.repartition(*key).select(*key, F.inline(F.arrays_zip("next", "n")))
    sums = dealt.groupBy(*key, "next").agg(F.sum("n").alias("n"))
    return sums.groupBy(*key).agg(
        F.sum("n").alias("total"), F.max("n").alias("most"),
        F.collect_list(F.when(F.col("n") >= least, F.struct("next", "n"))).alias("extensions"))


def known_bits(phrases: DataFrame) -> np.ndarray:
    """The filter of frequent phrases: a bounded number of 64-bit pieces, whatever the number of phrases."""
    size = FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                one = np.zeros(1, np.uint64)
                for w in word_hashes(phrase.encode().split(b" "), lang):
                    one = extended(one, w)
                h[i] = one[0]
            at = np.unique(places(h, size))
            slot, back = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "slot int, bits long").groupBy("slot").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint8)


def hot_parts(counted: DataFrame, total: int) -> dict[tuple[str, str], int]:
    """Parts of the stripes of prefixes with more than one in ``PARTS`` words; so there are at most that many."""
    rows = counted.filter(F.col("n") * PARTS > total).collect()
    return {(r["lang"], r["phrase"]): 1 + r["n"] * PARTS // total for r in rows}


def grouped(*columns: str) -> Column:
    return F.struct(*columns).alias("_at")


def collocations(df: DataFrame, lang: str, text: str, longest: int = 3, least: int = 10, cover: int = 50) -> DataFrame:
    """Phrases of 2 to ``longest`` words with ``least`` occurrences or more, and the score of their weakest cut.

    Texts are lower-cased (A to Z), cut into pieces at punctuation and line ends, and counted by language (null: ``und``).
    A phrase of a occurrences cut into parts of l and r scores floor(1,000,000 a a / (l r)); its lowest cut counts, of equal ones
    the first. Arithmetic is decimal and exact up to counts of 16 digits. A phrase goes if a longer one that
    holds it has at least ``cover`` percent of its occurrences. Null and empty texts have no words; repeated rows
    count again; empty tables give no rows; further columns are ignored.

    Returns lang, phrase, words, a, l, r, n (words of the language), score.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("_t"))
    counts, tops, sizes, known, hot = [], [], None, [], {}
    for words in range(longest):
        table = keep(merged(stripes(docs, words, known, hot), least), f"stripes-{words}")
        phrase = F.when(F.col("prefix") == "", F.col("x.next")).otherwise(F.concat_ws(" ", "prefix", "x.next"))
        found = keep(table.select("lang", "prefix", F.explode("extensions").alias("x")).select(
            "lang", "prefix", phrase.alias("phrase"), F.col("x.n").alias("n")), f"phrases-{words + 1}")
        counts.append(found)
        if words:
            # where no extension is frequent, nothing longer covers the prefix
            tops.append(table.filter(F.size("extensions") > 0).groupBy("lang", "prefix").agg(F.max("most").alias("most")))
        else:
            sizes = table.groupBy("lang").agg(F.sum("total").alias("n"))
        if words + 1 < longest:
            known.append(known_bits(found))
            hot = hot_parts(found, sizes.agg(F.sum("n")).first()[0] or 0)
    scored = reduce(DataFrame.unionByName, [
        _scored(counts, tops, m, m < longest, cover).withColumn("words", F.lit(m)) for m in range(2, longest + 1)])
    return scored.join(F.broadcast(sizes), "lang").select("lang", "phrase", "words", "a", "l", "r", "n", "score")


def _scored(counts: list[DataFrame], tops: list[DataFrame], m: int, covered: bool, cover: int) -> DataFrame:
    """Candidates of m words that no longer one covers, with their weakest cut."""
    word = F.split("phrase", " ")
    cut = lambda a, n: F.array_join(F.slice(word, a, n), " ")
    now = counts[m - 1].select("lang", "phrase", F.col("n").alias("a"))
    if covered:
        # the longer phrases that start with this one have their largest in the stripe, those that end with it are grouped
        tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
        ends = counts[m].groupBy("lang", tail.alias("phrase")).agg(F.max("n").alias("_longer"))
        starts = tops[m - 1].select("lang", F.col("prefix").alias("phrase"), F.col("most").alias("_longer"))
        longer = ends.unionByName(starts).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
        now = now.join(longer, ["lang", "phrase"], "left").filter(
            F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * cover)).drop("_longer")
    now = keep(now, f"candidates-{m}")
    for k in range(1, m):
        for side, at, n in (("l", 1, k), ("r", k + 1, m - k)):
            small = counts[n - 1].select(grouped("lang", "phrase"), F.col("n").alias(f"{side}{k}"))
            now = keep(join_unique(now.withColumn("_at", grouped("lang", cut(at, n).alias("phrase"))), small, "_at", "inner").drop("_at"),
                       f"candidates-{m}-{side}{k}")

    def exact(name: str) -> str:
        return f"cast({name} as decimal(16, 0))"

    cuts = F.array(*[F.struct(
        F.expr(f"(cast(1000000 as decimal(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact(f'l{k}')} * {exact(f'r{k}')})").alias("score"),
        F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)])
    return now.withColumn("_cut", F.array_min(cuts)).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
