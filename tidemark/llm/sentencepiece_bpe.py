"""Encoding and decoding by a SentencePiece BPE vocabulary with a table of each prefix's last token.

A token sequence is the result of the merges exactly if each pair of neighbours is: merging the pair's text
alone gives the pair back. So a text's prefixes can be labelled from left to right: among the tokens that end
at a place (an automaton finds them) there is one which is compatible with the last token of the prefix before it.
The ids are read off backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Entries of the memories of a worker: words (in two generations of this many) and pairs.
WORDS, PAIRS = 300_000, 500_000
NO_MERGE = 1 << 60
#: Longest stretch without a space that is kept in the memory of words.
LONG_WORD = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """Pieces, scores and kinds of a model file; the merges themselves are done here."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != model.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a model with identity normalisation and kept white space is needed")
        if any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        ranks = {score: i for i, score in enumerate(sorted({proto.pieces[i].score for i in self.ids.values()}, reverse=True))}
        self.order = {piece: ranks[proto.pieces[i].score] for piece, i in self.ids.items()}
        self.letters = {piece for piece in self.ids if len(piece) == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.end = next(i for i, p in enumerate(proto.pieces) if p.type == CONTROL and p.piece == "</s>")
        # spaces only lead pieces or stand alone, so no merge crosses from another letter to a space
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces with inner spaces are not supported")
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merge(piece) == [piece]:  # others never come out of the merges
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self._words: dict[str, tuple[int, bytes, bytes]] = {}
        self._older: dict[str, tuple[int, bytes, bytes]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, text: str, never: int = -1) -> list[str] | None:
        """The merges as defined: best score first, then leftmost; for short texts.

        ``never``: a place (in letters) over which nothing may merge; None if something would.
        """
        parts, order = list(text), self.order.get
        rank = [order(a + b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while rank and (best := min(rank)) != NO_MERGE:
            at = rank.index(best)
            if at < never:
                never -= 1
            elif at == never:
                return None
            joined = parts[at] + parts[at + 1]
            parts[at:at + 2] = [joined]
            del rank[at]
            if at:
                rank[at - 1] = order(parts[at - 1] + joined, NO_MERGE)
            if at < len(rank):
                rank[at] = order(joined + parts[at + 1], NO_MERGE)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        a = self.pieces[left]
        found = self.merge(a + self.pieces[right], len(a) - 1) is not None
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[left, right] = found
        return found

    def _known(self, word: str) -> list[int]:
        """Ids of a stretch whose letters are all in the vocabulary, by the table of its prefixes' last tokens."""
        last, size, known = [-1] * (len(word) + 1), [0] * (len(word) + 1), self._pairs.get
        for end, (length, token) in self.automaton.iter(word):
            if not size[end + 1]:
                before = last[end + 1 - length]
                if before >= 0:
                    fits = known((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                    if not fits:
                        continue
                last[end + 1], size[end + 1] = token, length
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _tokens(self, word: str) -> list[int]:
        """Ids of a stretch; a letter outside the vocabulary becomes its bytes and parts its neighbours."""
        if self.letters.issuperset(word):
            return self._known(word)
        out: list[int] = []
        for inside, run in groupby(word, self.letters.__contains__):
            run = "".join(run)
            out += self._known(run) if inside else [self.bytes[b] for b in run.encode("utf-8")]
        return out

    def word_ids(self, word: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as text, and the decoded bytes of one stretch."""
        found = self._words.get(word)
        if found is None:
            found = self._older.pop(word, None)
            if found is None:
                ids = self._tokens(word)
                found = len(ids), " ".join(map(str, ids)).encode(), self.plain(ids)
            if len(word) <= LONG_WORD:
                if len(self._words) >= WORDS:  # the older half goes; what is still used moves over
                    self._words, self._older = {}, self._words
                self._words[word] = found
        return found

    def plain(self, ids: list[int]) -> bytes:
        """Bytes of pieces with spaces in place of their marks; control ids give nothing."""
        return b"".join(
            bytes([int(self.pieces[i][3:5], 16)]) if self.kinds[i] == BYTE
            else b"" if self.kinds[i] == CONTROL
            else b" \xe2\x81\x87 " if self.kinds[i] == UNKNOWN
            else self.pieces[i].replace(SPACE, " ").encode() for i in ids)

    def stretches(self, text: str) -> list[str]:
        if not text:
            return []
        return self.word.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        """Ids with the end id."""
        return [i for w in self.stretches(text) for i in self._tokens(w)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes which are no UTF-8 become replacement characters, one each."""
        raw = self.plain(ids)
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, digest of the ids, digest of the decoded text; stretch by stretch."""
        n, ids, plain = 0, hashlib.sha256(), hashlib.sha256()
        words, known, first = self.stretches(text), self._words.get, self.word_ids
        for at in range(0, len(words), 4096):
            counts, listed, out = zip(*[known(w) or first(w) for w in words[at:at + 4096]])
            n += sum(counts)
            ids.update(b" ".join(listed) + b" ")
            decoded = b"".join(out)
            plain.update(decoded[1:] if at == 0 and self.prefix and decoded.startswith(b" ") else decoded)
            known = self._words.get
        ids.update(str(self.end).encode())
        return n + 1, ids.hexdigest(), plain.hexdigest()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def token_digests(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Number of ids, digest of the ids and of the decoded text of every row.

    Null texts are empty and have the end id only; repeated rows and null keys stay; an empty table gives no rows;
    further columns are ignored. Text is taken whole, in stretches, so memory does not grow with ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = [vocab.digests(t.as_py() or "") for t in batch.column(1)]
            n, ids, plain = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(key, text)
    return src.mapInArrow(
        run, f"`{key}` {dict(src.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """The ids themselves (with the end id) and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids = [vocab.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(vocab.decode, ids), pa.string())],
                names=[key, "ids", "decoded"])

    src = df.select(key, text)
    return src.mapInArrow(run, f"`{key}` {dict(src.dtypes)[key]}, ids array<int>, decoded string")
