"""Secret scan: candidates by pattern, told apart by how many owners in the whole corpus hold the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bind import bind, let
from tidemark.llm.common import join_unique, keep, text_or_empty
from tidemark.llm.components import components

#: Fixed patterns of the base kinds, in the order of the listing: kind, pattern, group of the value, least length.
BASE_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further candidate kinds: published formats of provider tokens, signed tokens and private keys.
MORE_KINDS = (
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29),
    ("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}", 0, 60),
)
#: Owners from which a value counts as a widely copied example.
SHARED_OWNERS = 3
#: Words on each side of a value, and characters they are looked for in, which tell a copied passage from another use.
AROUND, AROUND_CHARS = 6, 120
#: Matches of a text which are placed together.
PIECE = 256
#: Least length of a live-looking value; it also needs a digit.
LIVE_LENGTH = 16
MARK = "<secret>"
#: Most rows with live spans which are sent to every task; beyond it the join shuffles.
REDACT_ROWS = 50_000

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def found(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches as (start, rank, end, kind, value), leftmost and non-overlapping, in code points.

    Splitting at the matches gives what lies between them, so the offsets are running sums of lengths. Many matches are
    worked off in pieces of ``PIECE``, each from the sum of the lengths before it, so the work grows with the matches.
    """
    none = F.lit(None).cast(f"array<{SPAN}>")

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")).cast(f"struct<at:int,out:array<{SPAN}>>")

    def step(acc: Column, x: Column) -> Column:
        def put(at: Column) -> Column:
            end = at + F.length(x["whole"])
            span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
                            x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.when(x["whole"].isNull(), acc).otherwise(let(acc["at"] + F.length(x["between"]), put))

    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    def spans_of(some: Column, at: Column) -> Column:
        return F.aggregate(some, start(at), step, lambda acc: acc["out"])

    def in_pieces(all_parts: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.size(all_parts), F.lit(PIECE)), lambda i: F.slice(all_parts, i, PIECE))
        sizes = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["between"]) + F.coalesce(
            F.length(x["whole"]), F.lit(0))))
        firsts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(F.struct(pieces.alias("pieces"), firsts.alias("firsts")), lambda b: F.flatten(
            F.transform(b["pieces"], lambda p, i: spans_of(p, F.get(b["firsts"], i)))))

    out = let(parts, lambda all_parts: F.when(F.size(all_parts) <= PIECE, spans_of(all_parts, F.lit(0))).otherwise(in_pieces(all_parts)))
    out = F.filter(out, lambda s: F.length(s["value"]) >= least)
    return F.coalesce(F.when(text.rlike(pattern), out), none, F.array().cast(f"array<{SPAN}>"))


def spans(text: Column) -> Column:
    """All candidate spans of a text by start, then kind as listed, then end."""
    kinds = [*BASE_KINDS, *MORE_KINDS]
    return F.array_sort(F.concat(*[found(text, i, *k) for i, k in enumerate(kinds)]))


def _listed(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def around(text: Column, s: Column) -> tuple[Column, Column]:
    """Hashes of the words before and after a span's value (which ends the span); null where there are none."""
    def words(part: Column) -> Column:
        return F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def hashed(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.xxhash64(F.slice(x, 1, AROUND)))

    at = s["end"] - F.length(s["value"])
    before = F.substring(text, F.greatest(at - AROUND_CHARS, F.lit(0)) + 1, F.least(at, F.lit(AROUND_CHARS)))
    return hashed(F.reverse(words(before))), hashed(words(F.substring(text, s["end"] + 1, F.lit(AROUND_CHARS))))


def holders(values: DataFrame) -> DataFrame:
    """(hash, holders): passages a value stands in, where passages alike on either side of the value are one.

    So all copies and near copies of a text count once, unless words on both sides of the value were edited.
    """
    name = lambda side, x: F.xxhash64("hash", F.lit(side), x)
    both = values.select("hash", "left", "right").distinct().select(
        "hash", name("left", F.coalesce("left", name("right", F.col("right")))).alias("a"),
        name("right", F.coalesce("right", name("left", F.col("left")))).alias("b"))
    both = keep(both.distinct(), "secret-passages")
    roots = components(both.select("a", "b"), "a", "b")
    return both.join(roots, both["a"] == roots["node"]).select("hash", "root").distinct().groupBy("hash").agg(
        F.count("*").alias("holders"))


def scan(df: DataFrame, key: str, text: str, owner: str, repository: str | None = None,
         shared_owners: int = SHARED_OWNERS, by_passage: bool = False) -> DataFrame:
    """Candidate spans of every row, each with its class.

    A value's hash is counted by distinct repositories and owners over the whole corpus. Values of at least
    ``shared_owners`` owners are ``shared`` (copied examples); of the rest those of ``LIVE_LENGTH`` characters with a
    digit are ``live``, all others ``weak``. With ``by_passage`` they must also stand in as many different passages, so that
    a text copied to several owners does not make its own secrets examples. Without a repository column each key is a repository of its own. Null
    texts are empty, null owners are one owner, repeated rows count once in the frequencies and each keep their row,
    an empty table gives no rows, further columns are ignored.

    Returns key, ``text_hash`` (of the text, to tell rows of one key apart), ``found`` (array of start, end, kind, class, owners), ``n_live``, ``n_shared``, ``n_weak``.
    """
    src = df.select(F.col(key).alias("_k"), F.col(owner).alias("_o"), F.col(repository or key).alias("_r"),
                    text_or_empty(text).alias("_t"))
    rows = bind(src, _s=spans(F.col("_t"))).select(
        "_k", "_o", "_r", F.xxhash64("_t").alias("_h"), F.transform("_s", lambda s: F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
            F.sha2(s["value"], 256).alias("hash"),
            ((F.length(s["value"]) >= LIVE_LENGTH) & s["value"].rlike("[0-9]")).alias("live"),
            *([x.alias(n) for n, x in zip(("left", "right"), around(F.col("_t"), s))] if by_passage else []))).alias("_s"))
    rows = keep(rows, "secret-spans")
    one = rows.select("_k", "_o", "_r", "_h", F.explode("_s").alias("_x")).select("_k", "_o", "_r", "_h", "_x.*")
    owners = (
        one.groupBy("hash", "_o", "_r").agg(F.lit(1).alias("_1"))
        .groupBy("hash", "_o").agg(F.count("*").alias("repositories"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    shared = owners.filter(F.col("owners") >= shared_owners)
    if by_passage:
        shared = keep(shared, "secret-owners")
        several = holders(one.join(shared.select("hash"), "hash", "left_semi"))
        shared = shared.join(several.filter(F.col("holders") >= shared_owners), "hash", "left_semi")
        one = one.drop("left", "right")
    # a row may come twice: its spans are marked once and joined to each copy
    marked = join_unique(one.drop("_o", "_r").distinct(), shared, "hash").groupBy("_k", "_h").agg(
        F.array_sort(F.collect_list(F.struct(
            "start", "rank", "end", "kind",
            F.when(F.col("owners").isNotNull(), "shared").when(F.col("live"), "live").otherwise("weak").alias("class"),
            "owners", "repositories"))).alias("found"))
    some = rows.filter(F.size("_s") > 0).select(F.col("_k").alias("_k2"), F.col("_h").alias("_h2")).join(
        marked, (F.col("_h2") == F.col("_h")) & F.col("_k2").eqNullSafe(F.col("_k")))
    none = rows.filter(F.size("_s") == 0).select("_k", "_h", F.array().cast(
        "array<struct<start:int,rank:int,end:int,kind:string,class:string,owners:bigint,repositories:bigint>>"
    ).alias("found"))
    out = some.select("_k", "_h", "found").unionByName(none)

    def n(cls: str) -> Column:
        return F.size(F.filter("found", lambda s: s["class"] == cls)).cast("long").alias(f"n_{cls}")

    return out.select(F.col("_k").alias(key), F.col("_h").alias("text_hash"), "found",
                      n("live"), n("shared"), n("weak"))


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the listing of all spans."""
    names = [k[0] for k in BASE_KINDS]
    base = F.filter("found", lambda s: s["kind"].isin(names))

    def n(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(key, *[n(k) for k in names], F.sha2(_listed(base), 256).alias("base_sha256"),
                          _listed(F.col("found")).alias("spans"), "n_live", "n_shared", "n_weak")


def redact(docs: DataFrame, scanned: DataFrame, key: str = "doc_id", text: str = "text", mark: str = MARK) -> DataFrame:
    """Documents with every live span replaced by a mark; overlapping spans get one mark.

    Only rows with a live span are joined by key and rebuilt; the others pass unchanged.
    """
    live = F.filter("found", lambda s: s["class"] == "live")
    hit = scanned.filter(F.col("n_live") > 0).select(
        F.col(key).alias("_span_key"), F.col("text_hash").alias("_span_text"), live.alias("_span_live")).dropDuplicates(["_span_key", "_span_text"])
    if hit.limit(REDACT_ROWS + 1).count() <= REDACT_ROWS:
        hit = F.broadcast(hit)
    t = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], before, F.lit(mark))).alias("out")))

    rebuilt = F.aggregate("_span_live", start, step,
                          lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    joined = docs.join(hit, F.col(key).eqNullSafe(F.col("_span_key")) & (
        F.xxhash64(text_or_empty(text)) == F.col("_span_text")), "left")
    return joined.withColumn(text, F.when(F.col("_span_live").isNull() | t.isNull(), t).otherwise(rebuilt)).drop(
        "_span_key", "_span_text", "_span_live")
