"""Periodic runs of words, caught online by blocks of power-of-two lengths.

Every aligned block of ``2**k`` words, once complete, becomes a catcher: it waits for its own second occurrence at the
distances ``2**(k+1) - 1`` to ``2**(k+2) - 2``. A square of one of these periods has such a block in its first half, so it
cannot pass unnoticed. Neighbouring catchers that report the same distance form a streak: its squares merge into one
run, whose ends are found by comparing the words before and after it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bind import let
from tidemark.llm.common import id_text, text_or_empty

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of neighbouring texts that are appended together; a longer text is appended in stretches of this many.
APPENDED = 1 << 17
#: Neighbouring blocks inside every run that is long enough: its compared part has 3 periods, of two blocks each, less an end.
STREAK = 4


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Level:
    """Catchers of one block length: hashes from the first unsettled block on, and the streak open at each distance."""

    def __init__(self, k: int):
        self.size, self.near, self.wide = 1 << k, (2 << k) - 1, 2 << k
        self.base = 0
        self.h = np.empty(0, np.uint64)
        self.open = np.full(self.wide, -1, np.int64)

    def settle(self, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streaks (first word, word after the last, distance) that ended among the blocks whose distances are all known."""
        none = np.empty(0, np.int64)
        h, reach = self.h, self.near + self.wide - 1
        if last:
            rows = -(-len(h) // self.size)
            # no word follows: what stands there equals nothing
            h = np.concatenate((h, mixed(np.arange(reach + self.size, dtype=np.uint64) + np.uint64(len(h)))))
        else:
            rows = (len(h) - reach - 1) // self.size + 1
        if rows <= 0:
            return none, none, none
        seen = np.lib.stride_tricks.sliding_window_view(h[self.near:], self.wide)[::self.size][:rows]
        same = np.empty((rows + 1 + last, self.wide), bool)
        same[0] = self.open >= 0
        np.equal(seen, h[:rows * self.size:self.size][:, None], out=same[1:rows + 1])
        if last:
            same[-1] = False
        row, col = np.nonzero(same[1:] != same[:-1])
        begins = same[1:][row, col]
        first = self.base // self.size
        held = np.flatnonzero(same[0])
        b_col = np.concatenate((held, col[begins]))
        b_at = np.concatenate((self.open[held], row[begins] + first))
        e_col, e_at = col[~begins], row[~begins] + first
        order = np.lexsort((b_at, b_col))
        b_col, b_at = b_col[order], b_at[order]
        order = np.lexsort((e_at, e_col))
        e_col, e_at = e_col[order], e_at[order]
        still = np.flatnonzero(same[-1])
        self.open = np.full(self.wide, -1, np.int64)
        if len(still):
            at = np.searchsorted(b_col, still, "right") - 1
            self.open[still] = b_at[at]
            b_col, b_at = np.delete(b_col, at), np.delete(b_at, at)
        self.h = self.h[rows * self.size:]
        self.base += rows * self.size
        long = e_at - b_at >= STREAK
        return b_at[long] * self.size, e_at[long] * self.size, b_col[long] + self.near


class SquareCatcher:
    """Runs of a growing sequence of word codes; ``append`` any number of words at a time, then ``finish``."""

    def __init__(self, longest: int = 1 << 40):
        self.levels: list[Level] = []
        while max(LEAST_WORDS, LEAST_PERIODS * ((2 << len(self.levels)) - 1)) <= longest:
            self.levels.append(Level(len(self.levels)))
        self.words = np.empty(1024, np.int64)
        self.n = 0
        #: Runs by the level that found them: start, end, period.
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in self.levels]

    def append(self, codes: np.ndarray) -> None:
        if self.n + len(codes) > len(self.words):
            grown = np.empty(max(2 * len(self.words), self.n + len(codes)), np.int64)
            grown[:self.n] = self.words[:self.n]
            self.words = grown
        self.words[self.n:self.n + len(codes)] = codes
        self.n += len(codes)
        new = mixed(codes.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))
        for k, level in enumerate(self.levels):
            if not len(new):
                break
            known = level.base + len(level.h)
            level.h = np.concatenate((level.h, new)) if len(level.h) else new
            # hashes of twice the length end where both halves are known
            begin, end = max(0, known - level.size), known + len(new) - level.size
            a = level.h[begin - level.base:max(begin, end) - level.base]
            b = level.h[begin + level.size - level.base:max(begin, end) + level.size - level.base]
            new = mixed(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(27))) + np.uint64(k + 1))
            self._catch(k, *level.settle(False))

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period) by start, then period."""
        for k, level in enumerate(self.levels):
            self._catch(k, *level.settle(True))
        least: dict[tuple[int, int], int] = {}
        for s, e, q in (r for found in self.runs for r in found):
            least[s, e - s] = min(q, least.get((s, e - s), q))
        return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))

    def _catch(self, k: int, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> None:
        """Turn streaks into runs; those inside a run of a lower level repeat its squares."""
        if not len(lo):
            return
        size = self.levels[k].size
        ok = hi - lo + 2 * (size - 1) >= least_compared(q)
        below = sorted(r for found in self.runs[:k] for r in found)
        if below:
            starts = np.array([r[0] for r in below])
            ends = np.maximum.accumulate(np.array([r[1] for r in below]))
            at = np.searchsorted(starts, lo, "right") - 1
            ok &= (at < 0) | (ends[np.maximum(at, 0)] < hi + q)
        for a, b, period in zip(lo[ok].tolist(), hi[ok].tolist(), q[ok].tolist()):
            self._extend(k, size, a, b, period)

    def _extend(self, k: int, size: int, lo: int, hi: int, q: int) -> None:
        w = self.words[:self.n]
        left = max(0, lo - size + 1)
        differ = np.flatnonzero(w[left:lo] != w[left + q:lo + q])
        lo = left + int(differ[-1]) + 1 if len(differ) else left
        right = min(self.n - q, hi + size - 1)
        differ = np.flatnonzero(w[hi:right] != w[hi + q:right + q])
        hi = hi + int(differ[0]) if len(differ) else max(hi, right)
        # hashes led here; the words decide
        differ = lo + np.flatnonzero(w[lo:hi] != w[lo + q:hi + q])
        cuts = [lo - 1, *differ.tolist(), hi]
        for a, b in zip(cuts, cuts[1:]):
            if b - a - 1 >= max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q):
                self.runs[k].append((a + 1, b + q, q))


def least_compared(q: np.ndarray) -> np.ndarray:
    """Words that must equal the word one period later in a run of this period."""
    return np.maximum(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but blank, tab and line ends."""
    return (text or "").encode("utf-8", "replace").split()


def runs_of(codes: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts, which are caught in one sequence with a word of its own after every text."""
    catcher = SquareCatcher(max((len(c) for c in codes), default=0))
    starts = np.cumsum([0] + [len(c) + 1 for c in codes])
    joined = np.empty(int(starts[-1]), np.int64)
    for i, c in enumerate(codes):
        joined[starts[i]:starts[i] + len(c)] = c
        joined[starts[i + 1] - 1] = -1 - i
    for at in range(0, len(joined), APPENDED):
        catcher.append(joined[at:at + APPENDED])
    out: list[list[tuple[int, int, int]]] = [[] for _ in codes]
    for s, n, q in catcher.finish():
        i = int(np.searchsorted(starts, s, "right")) - 1
        out[i].append((s - int(starts[i]), n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run contains after its first period, joined by one blank."""
    if runs:
        stays = np.ones(len(words), bool)
        for s, n, q in runs:
            stays[s + q:s + n] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return b" ".join(words)


def with_repeats(key: str, text: str) -> Column:
    """Text in which, for one key in ten by hash, the words from some word on repeat with a period taken from the hash.

    Runs of long periods are rare in plain text; this gives them. A null key counts as an empty one.
    """
    h = F.crc32(id_text(key))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        g = F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a.cast("int")), tail), " ")).otherwise("")

    words = F.filter(F.split(text_or_empty(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(text_or_empty(text))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, ``runs`` (array of start, length, period by start, then period) and ``collapsed`` text of every row.

    A run is a stretch of words with smallest period q, at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods
    long, that no neighbouring word extends. Whole texts of any length: null, empty and blank texts have no run and collapse to
    the empty text; equal rows and null keys each keep their row; an empty table gives none; further columns are ignored.
    """

    def flush(kind: pa.DataType, keys: list, held: list[list[bytes]]) -> pa.RecordBatch:
        codes = defaultdict(count().__next__)
        found = runs_of([np.fromiter(map(codes.__getitem__, w), np.int64, len(w)) for w in held])
        offsets = np.cumsum([0] + [len(r) for r in found]).astype(np.int32)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
        texts = pa.array([collapsed(w, r) for w, r in zip(held, found)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), pa.ListArray.from_arrays(pa.array(offsets), structs), texts], names=["_k", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                keys.append(k.as_py())
                held.append(words_of(t.as_py()))
                n += len(held[-1])
                if n >= APPENDED or len(keys) >= 10_000:
                    yield flush(batch.column(0).type, keys, held)
                    keys, held, n = [], [], 0
            if keys:
                yield flush(batch.column(0).type, keys, held)
                keys, held, n = [], [], 0

    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    out = src.mapInArrow(run, f"_k {dict(src.dtypes)['_k']}, "
                              "runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("_k", key)
