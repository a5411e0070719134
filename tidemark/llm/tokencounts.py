"""Token counts which follow edits: only the pre-tokens touched by an edit and their surroundings are encoded again.

A byte-level tokenizer first cuts a text into pre-tokens by a pattern, then merges inside each. Cutting goes from
left to right and looks ahead only, so from any cut on, the rest depends on the rest alone. Each document keeps its
pre-tokens in blocks under a binary tree of sums (characters and tokens). An edit finds its block through the
sums, cuts again from a few pre-tokens before it until a new cut falls on an old one, and updates the sums above.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of a fresh block, pre-tokens before an edit that are cut again, entries of a worker's memory.
BLOCK, BEFORE, MEMORY = 64, 2, 400_000
#: Characters behind an edit that are cut at first, doubled until cuts meet again.
AHEAD = 64


class Encoder:
    """Number of tokens of pre-tokens, kept in a bounded memory."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memory: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.memory.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[piece] = n
        return n


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


class Document:
    """Pre-tokens of a text in blocks; sums of characters and tokens in a binary tree over the blocks."""

    def __init__(self, text: str, coder: Encoder):
        self.coder = coder
        self.encoded = 0  # pre-tokens encoded, the first time and after edits
        pieces = coder.pattern.findall(text)
        self.blocks = [pieces[i:i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.counts = [self._count(b) for b in self.blocks]
        for i, block in enumerate(self.blocks):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, block)), sum(self.counts[i])
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _count(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return [self.coder.count(p) for p in pieces]

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _update(self, block: int) -> None:
        i = self.size + block
        self.chars[i], self.tokens[i] = sum(map(len, self.blocks[block])), sum(self.counts[block])
        while i > 1:
            i //= 2
            self._sum(i)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, pre-token and its start for a place in the text; the last pre-token for its end."""
        i, base = 1, 0
        while i < self.size:
            i *= 2
            if at >= base + self.chars[i] and self.chars[i + 1]:
                base += self.chars[i]
                i += 1
        block = i - self.size
        for n, piece in enumerate(self.blocks[block]):
            if at < base + len(piece) or n == len(self.blocks[block]) - 1:
                return block, n, base
            base += len(piece)
        return block, 0, base

    def _back(self, block: int, n: int, start: int, steps: int) -> tuple[int, int, int]:
        while steps:
            if n:
                n -= 1
            else:
                before = block - 1
                while before >= 0 and not self.blocks[before]:
                    before -= 1
                if before < 0:
                    break
                block, n = before, len(self.blocks[before]) - 1
            start -= len(self.blocks[block][n])
            steps -= 1
        return block, n, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end (clipped to the text) by a new text."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        block, n, at = self._back(*self._find(max(0, start - 1)), BEFORE)
        rows: list[tuple[int, int]] = []  # old pre-tokens read so far, as (block, place)
        text, stop = [], at
        b, m, ahead = block, n, AHEAD

        def more(upto: int) -> None:
            nonlocal b, m, stop
            while stop < upto and b < len(self.blocks):
                if m >= len(self.blocks[b]):
                    b, m = b + 1, 0
                    continue
                rows.append((b, m))
                text.append(self.blocks[b][m])
                stop += len(self.blocks[b][m])
                m += 1

        while True:
            more(end + ahead)
            last = stop >= self.length
            old = "".join(text)
            fresh = old[:start - at] + new + old[end - at:]
            shift = len(new) - (end - start)
            cuts, place = set(), at
            for piece in text:
                place += len(piece)
                if place >= end:
                    cuts.add(place + shift - at)
            pieces, used = [], 0
            met = False
            for match in self.coder.pattern.finditer(fresh):
                if used in cuts and used >= start - at + len(new) and pieces:
                    met = True
                    break
                if not last and match.end() >= len(fresh) - 1:  # what lies behind may change this one
                    break
                pieces.append(match.group())
                used = match.end()
            else:
                met = last
            if met or used in cuts and used >= start - at + len(new) and pieces:
                break
            ahead *= 2
        keep_from = used - shift + at  # old place at which the old cuts hold again
        gone, place = [], at
        for row, piece in zip(rows, text):
            if place >= keep_from:
                break
            gone.append(row)
            place += len(piece)
        counts = self._count(pieces)
        touched = sorted({r[0] for r in gone} | {block})
        for t in touched:
            places = [r[1] for r in gone if r[0] == t]
            low, high = (places[0], places[-1] + 1) if places else (n, n)
            put, got = (pieces, counts) if t == block else ([], [])
            self.blocks[t][low:high] = put
            self.counts[t][low:high] = got
            self._update(t)


def count_edited(docs: DataFrame, key: str, text: str, edits: str, ranks_path: str, pattern: str) -> DataFrame:
    """Counts before and after a row's own edits, an array of (start, end, new) by place in the original text.

    Edits are applied from the last to the first, so their places stay valid; an edit that overlaps a later one is cut
    at its start. Null texts are empty, null edits and edits with null places are none, a null ``new`` is empty; places
    outside are clipped; repeated rows and null keys stay; an empty table gives no rows; further columns are ignored.

    Returns key, ``n_before``, ``n_edits``, ``n_after``, ``n_encoded`` (pre-tokens encoded again).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path, pattern)
        for batch in batches:
            rows = [edited_counts(t.as_py() or "", e.as_py() or [], coder)
                    for t, e in zip(batch.column(1), batch.column(2))]
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=[key, "n_before", "n_edits", "n_after", "n_encoded"])

    src = docs.select(key, F.col(text).alias("_text"), F.col(edits).alias("_edits"))
    counts = "n_before long, n_edits long, n_after long, n_encoded long"
    return src.mapInArrow(run, f"`{key}` {dict(src.dtypes)[key]}, {counts}")


def edited_counts(text: str, edits: Iterable[dict], coder: Encoder) -> tuple[int, int, int, int]:
    doc = Document(text, coder)
    before, first = doc.total, doc.encoded
    todo = sorted(((e["start"], e["end"], e["new"] or "") for e in edits
                   if e["start"] is not None and e["end"] is not None), reverse=True)
    upto = len(text)
    for start, end, new in todo:
        doc.edit(start, min(end, upto), new)
        upto = min(upto, max(start, 0))
    return before, len(todo), doc.total, doc.encoded - first
