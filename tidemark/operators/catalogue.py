"""Dictionary against stored state, display orders, topics, related roles, search, import."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.bind import bind, let, unfold
from tidemark.functions.presentation import resolved_summary
from tidemark.functions.profile import profile_columns, profile_reasons, profile_summary, profile_text
from tidemark.functions.rates import severity_rank
from tidemark.functions.text import by_name, collapse_space, expand_terms
from tidemark.operators.ranking import last_value_first_position, top_k
from tidemark.session import cut_lineage

PROFILE_FIELDS = (
    "replacement_rate", "risk_level", "rating_status", "repetition_score", "rule_clarity_score",
    "transformation_score", "workflow_automation_score", "interpersonal_score", "physicality_score",
    "ambiguity_score",
)
#: Parts over which the holders of one keyword are dealt.
SALTS = 8
#: Most words of a keyword set that meets by its subsets; the dictionary builds no longer ones.
SUBSET_WORDS = 8


# ---- profile and stored state ----------------------------------------------------------------
def with_profile(roles: DataFrame, source_count: Column | None = None, prefix: str = "") -> DataFrame:
    """Adds rate, level, scores and summaries inferred from slug, name and keywords."""
    count = F.lit(0) if source_count is None else source_count
    text = profile_text(F.col("slug"), F.col("name_en"), F.col("keywords"))
    bound = roles.select("*", F.inline(F.array(F.struct(text.alias("_text"), count.alias("_count")))))
    added = profile_columns(F.col("_text"), F.col("_count"))
    added["summary_en"] = profile_summary(F.col("_count"), "en")
    added["summary_zh"] = profile_summary(F.col("_count"), "zh")
    added["reasons"] = profile_reasons(F.col("_text"), F.col("_count"))
    return bound.withColumns({prefix + n: c for n, c in added.items()}).drop("_text", "_count")


def with_stored_state(roles: DataFrame, state: DataFrame) -> DataFrame:
    """Dictionary rows with the stored fields, each falling back to the inferred one."""
    inferred = with_profile(roles, prefix="i_")
    stored = state.select(
        "slug", *[F.col(c).alias(f"s_{c}") for c in (
            "name_en", "name_zh", "replacement_rate", "risk_level", "rating_status",
            "risk_summary_en", "risk_summary_zh")]
    )
    joined = inferred.join(stored, "slug", "left")

    def pick(stored_name: str, other: str) -> Column:
        return F.coalesce(F.col(f"s_{stored_name}"), F.col(other)).alias(stored_name)

    return joined.select(
        "slug", "industry_code", "keywords", "is_active",
        pick("name_en", "name_en"), pick("name_zh", "name_zh"),
        pick("replacement_rate", "i_replacement_rate"), pick("risk_level", "i_risk_level"),
        pick("rating_status", "i_rating_status"), pick("risk_summary_en", "i_summary_en"),
        pick("risk_summary_zh", "i_summary_zh"),
    )


HOME_FIELDS = (
    "name_en", "name_zh", "risk_level", "rating_status", "coverage", "replacement_rate",
    "risk_summary_en", "risk_summary_zh",
)


def override_union(dictionary: DataFrame, stored: DataFrame, fields: Sequence[str] = HOME_FIELDS) -> DataFrame:
    """A stored row replaces the dictionary row of its slug as a whole; extra stored rows stay."""
    d = dictionary.select("slug", F.struct(*fields).alias("_d"))
    s = stored.select("slug", F.struct(*fields).alias("_s"))
    row = F.coalesce("_s", "_d")
    return d.join(s, "slug", "full").select("slug", row.alias("_r")).select("slug", "_r.*")


def missing_state(dictionary: DataFrame, state: DataFrame) -> DataFrame:
    """State rows for dictionary roles which have none, from their profile."""
    return with_profile(dictionary.join(state.select("slug"), "slug", "left_anti"))


# ---- display orders --------------------------------------------------------------------------
def _translated_first() -> Column:
    return F.when(F.col("name_zh") != F.col("name_en"), 0).otherwise(1)


def _priority_first() -> Column:
    return F.when(F.col("slug").isin(*rules.PRIORITY_SLUGS), 0).otherwise(1)


def display_order() -> list[Column]:
    return [
        _priority_first().asc(), _translated_first().asc(), severity_rank(F.col("risk_level")).asc(),
        by_name(F.col("name_en")).asc(), F.col("slug").asc(),
    ]


def home_order() -> list[Column]:
    """Coverage, then rated ones; the display keys count among unrated rows only."""
    unrated = F.col("rating_status") != "RATED"
    return [
        F.col("coverage").desc(),
        F.when(unrated, 1).otherwise(0).asc(),
        F.when(unrated, _priority_first()).otherwise(0).asc(),
        F.when(unrated, _translated_first()).otherwise(0).asc(),
        severity_rank(F.col("risk_level")).asc(),
        by_name(F.col("name_en")).asc(),
        F.col("slug").asc(),
    ]


def home_rows(dictionary: DataFrame, state: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every home row before the cut: stored rows over inferred ones, with coverage."""

    def counted(df: DataFrame) -> DataFrame:
        return df.join(coverage, "slug", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))

    stored = counted(state).withColumns(
        {
            f"risk_summary_{loc}": resolved_summary(F.col(f"risk_summary_{loc}"), F.col("coverage"), loc)
            for loc in ("en", "zh")
        }
    )
    inferred = with_profile(counted(dictionary.filter("is_active")), F.col("coverage")).withColumns(
        {"risk_summary_en": F.col("summary_en"), "risk_summary_zh": F.col("summary_zh")}
    )
    return override_union(inferred, stored)


def home_list(rows: DataFrame, limit: int = rules.HOME_WORKING_SET) -> DataFrame:
    return rows.orderBy(*home_order()).limit(limit)


def home_ranking(rows: DataFrame, limit: int = rules.RANKING_SIZE) -> DataFrame:
    """Highest rates among the rows of the home list: the first cut comes before the filter."""
    listed = home_list(rows).filter(F.col("replacement_rate").isNotNull())
    return listed.orderBy(F.col("replacement_rate").desc(), by_name(F.col("name_en")), "slug").limit(limit)


def least_covered(rows: DataFrame, k: int, blocked: Sequence[str] = rules.BLOCKED_DISCOVERY_SLUGS) -> DataFrame:
    """The k home rows with least coverage; blocked slugs leave after the cut."""
    cut = home_list(rows).orderBy(F.col("coverage").asc(), by_name(F.col("name_en")).asc(), F.col("slug").asc()).limit(k)
    slug = F.trim("slug")
    return cut.select(slug.alias("slug"), "coverage").filter(
        (F.length("slug") > 0) & ~F.lower("slug").isin(*blocked)
    ).dropDuplicates(["slug"])


def suggestions(dictionary: DataFrame, limit: int) -> DataFrame:
    rows = dictionary.filter("is_active").withColumn("risk_level", F.lit("LOW"))
    return rows.orderBy(*display_order()).limit(limit).select("slug", "name_en", "name_zh")


def page(rows: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Rows of the first ``number`` pages of a list which grows by a page at a time."""
    return rows.orderBy(*order).limit(size * number)


# ---- topics ----------------------------------------------------------------------------------
def _keyword_terms(spark, words: Sequence[str]) -> list[str]:
    """Expanded terms of a topic's own few keywords."""
    row = spark.range(1).select(expand_terms(F.array(*[F.lit(w) for w in words])).alias("t")).first()
    return list(row["t"])


def topic_members(roles: DataFrame, words: Sequence[str]) -> DataFrame:
    """Roles any of whose expanded keywords is among the topic's expanded terms."""
    terms = F.array(*[F.lit(t) for t in _keyword_terms(roles.sparkSession, words)])
    return roles.filter(F.arrays_overlap(expand_terms(F.col("keywords")), terms))


def topic_rows(
    rows: DataFrame, topics: Mapping[str, tuple[Sequence[str] | None, int | None, int]] = rules.TOPICS
) -> DataFrame:
    """Ranked rows of every topic: highest rate first, unknown rates last.

    One pass over the rows finds all topics of each; the topic list is configuration.
    """
    spark = rows.sparkSession
    tests = []
    for slug, (words, minimum, limit) in topics.items():
        member = F.lit(True)
        if words:
            terms = F.array(*[F.lit(t) for t in _keyword_terms(spark, words)])
            member = F.arrays_overlap(F.col("_terms"), terms)
        if minimum is not None:
            member = member & F.coalesce(F.col("replacement_rate") >= minimum, F.lit(False))
        tests.append(F.when(member, F.struct(F.lit(slug).alias("topic"), F.lit(limit).alias("topic_limit"))))
    marked = rows.select("*", F.inline(F.array(F.struct(expand_terms(F.col("keywords")).alias("_terms")))))
    joined = marked.select("*", F.inline(F.filter(F.array(*tests), lambda t: t.isNotNull()))).drop("_terms")
    order = [F.col("replacement_rate").desc_nulls_last(), by_name(F.col("name_en")).asc(), F.col("slug").asc()]
    widest = max(limit for _, _, limit in topics.values())
    ranked = top_k(joined, ["topic"], order, widest, rank="topic_rank")
    return ranked.filter(F.col("topic_rank") <= F.col("topic_limit")).drop("topic_limit")


def featured_topics(
    rows: DataFrame, featured: Sequence[str] = rules.FEATURED_TOPICS,
    topics: Mapping[str, tuple[Sequence[str] | None, int | None, int]] = rules.TOPICS,
) -> DataFrame:
    """Ranked rows of the featured topics with ``featured_rank``, their place in the list; all must be defined."""
    missing = [slug for slug in featured if slug not in topics]
    if missing:
        raise ValueError(f"featured topics without a definition: {', '.join(missing)}")
    place = F.element_at(F.create_map(*[x for i, s in enumerate(featured, 1) for x in (F.lit(s), F.lit(i))]), F.col("topic"))
    return topic_rows(rows, {slug: topics[slug] for slug in featured}).withColumn("featured_rank", place)


# ---- related roles ---------------------------------------------------------------------------
def _subsets(words: Column) -> Column:
    """All subsets of a short list of distinct sorted words, the empty one too: ``_words`` as joined text and ``_held``."""
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1)
    held = F.transform(masks, lambda m: F.filter(
        words, lambda w, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1))
    return F.transform(held, lambda s: F.struct(
        F.array_join(F.transform(s, lambda w: F.concat(F.lit("\x1f"), w)), "").alias("_words"), s.alias("_held")))


def related_roles(roles: DataFrame, k: int) -> DataFrame:
    """Per role the k active roles of its group which share most keywords.

    Ties go to translated ones, then by name. Not roles but distinct keyword sets meet: the active roles of a
    group with one set form a signature, of which only the first k + 1 by the tie order can reach any result, and
    roles with equal group and keywords share one lookup. They meet by subsets of words: each subset keeps
    the first k + 1 signatures that hold it. A signature beyond those has k + 1 before it which share as many words
    with every lookup of that subset, so no result is lost, and a word held by all sets costs k + 1 rows. Sets of more
    than ``SUBSET_WORDS`` words, which the dictionary does not build, meet word by word instead.
    """
    cleaned = roles.select(
        "slug", "name_en", "name_zh", "industry_code", "is_active",
        F.array_sort(F.transform("keywords", F.lower)).alias("_list"),
    ).withColumn("_set", F.array_sort(F.array_distinct("_list")))
    tie = [_translated_first().asc(), by_name(F.col("name_en")).asc(), F.col("slug").asc()]
    active = cleaned.filter("is_active").withColumn("_sig", F.array_join("_set", "\x1f"))
    best = top_k(active.select("slug", "name_en", "name_zh", "industry_code", "_sig"), ["industry_code", "_sig"], tie, k + 1)
    signatures = active.groupBy("industry_code", "_sig").agg(
        F.min(F.struct(_translated_first().alias("u"), by_name(F.col("name_en")).alias("n"), F.col("slug").alias("s"))).alias("_first"),
        F.first("_set").alias("_set"))
    lookup = F.concat_ws("\x1e", "industry_code", F.array_join("_list", "\x1f")).alias("_lookup")
    lookups = cleaned.select("industry_code", "_list", "_set", lookup).groupBy("industry_code", "_lookup").agg(
        F.first("_list").alias("_list"), F.first("_set").alias("_set"))
    short = F.when(F.size("_set") <= SUBSET_WORDS, F.col("_set")).otherwise(F.array().cast("array<string>"))
    held = top_k(unfold(signatures, _subsets(short), "industry_code", "_sig", "_first").drop("_held"),
                 ["industry_code", "_words"], [F.col("_first").asc()], k + 1)
    asked = unfold(lookups, _subsets(short), "industry_code", "_lookup", "_list").select(
        "industry_code", "_lookup", "_words",
        F.size(F.filter("_list", lambda w: F.array_contains("_held", w))).cast("long").alias("overlap"))
    shared = asked.join(held, ["industry_code", "_words"]).select("industry_code", "_lookup", "_sig", "_first", "overlap")
    if cleaned.filter(F.size("_set") > SUBSET_WORDS).limit(1).count():
        shared = shared.unionByName(_met_by_words(lookups, signatures))
    nearest = top_k(
        shared.groupBy("industry_code", "_lookup", "_sig").agg(F.max("overlap").alias("overlap"), F.min("_first").alias("_first")),
        ["_lookup"], [F.col("overlap").desc(), F.col("_first").asc()], k + 1).drop("_first")
    found = nearest.join(best, ["industry_code", "_sig"])
    # at most k + 1 in order; a role leaves itself out of its own list, which needs no second sort
    per_lookup = top_k(found, ["_lookup"], [F.col("overlap").desc(), *tie], k + 1, rank="_r").groupBy("_lookup").agg(
        F.array_sort(F.collect_list(F.struct("_r", F.col("slug").alias("related_slug"), F.col("overlap").cast("int").alias("overlap")))).alias("_near"))
    bases = cleaned.select(F.col("slug").alias("base_slug"), lookup)
    own = F.slice(F.filter("_near", lambda x: x["related_slug"] != F.col("base_slug")), 1, k)
    return bases.join(per_lookup, "_lookup").select("base_slug", F.posexplode(own).alias("_i", "_x")).select(
        "base_slug", (F.col("_i") + 1).alias("related_rank"), "_x.related_slug", "_x.overlap")


def _met_by_words(lookups: DataFrame, signatures: DataFrame) -> DataFrame:
    """Overlaps of lookups and signatures of which one has too many words for subsets; they meet by (group, word), dealt over salts."""
    wide = F.size("_set") > SUBSET_WORDS
    holders = signatures.select("industry_code", "_sig", "_first", wide.alias("_wide"), F.explode("_set").alias("_word")).withColumn(
        "_salt", F.pmod(F.xxhash64("_sig"), F.lit(SALTS)).cast("int"))
    asked = lookups.select("industry_code", "_lookup", wide.alias("_wide"), F.explode("_list").alias("_word")).groupBy(
        "industry_code", "_lookup", "_wide", "_word").agg(F.count("*").alias("_times")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = asked.alias("a").join(holders.alias("h"), ["industry_code", "_word", "_salt"]).filter(F.col("a._wide") | F.col("h._wide"))
    return met.groupBy("industry_code", "_lookup", "_sig").agg(F.min("_first").alias("_first"), F.sum("_times").alias("overlap"))


# ---- name search -----------------------------------------------------------------------------
def search_score(query: str, texts: Sequence[Column]) -> Column:
    """Ladder of matches for one folded query text over folded candidate texts, -1 where none."""
    if not query:
        return F.lit(1)
    words = [w for w in query.split(" ") if w]
    letters = query.replace(" ", "")
    subsequence = ".*".join(_quote(ch) for ch in letters)

    def of_text(t: Column) -> Column:
        position = F.instr(t, query)
        all_words = F.lit(True)
        for w in words:
            all_words = all_words & F.contains(t, F.lit(w))
        return (
            F.when(F.length(t) == 0, -1)
            .when(t == query, 1000)
            .when(position > 0, F.when(position == 1, 900).otherwise(F.lit(801) - position))
            .when(all_words, F.lit(650) - F.length(t))
            .when(F.rlike(F.replace(t, F.lit(" "), F.lit("")), F.lit(f"(?s){subsequence}")),
                  F.lit(500) - F.length(t))
            .otherwise(-1)
        )

    scores = [of_text(t) for t in texts]
    return F.greatest(F.lit(-1), *scores)


def _quote(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch


def search_names(names: DataFrame, queries: Sequence[str], folded: Sequence[str], label: str) -> DataFrame:
    """Best matches of typed queries over a dictionary, ``query`` and ``score``: the first 8, or 6 for a blank query.

    One pass over the dictionary answers all queries.
    """
    scores = [F.struct(F.lit(q).alias("query"), search_score(q, [F.col(c) for c in folded]).alias("score")) for q in queries]
    scored = unfold(names, F.filter(F.array(*scores), lambda x: x["score"] >= 0), *names.columns)
    order = [F.col("score").desc(), by_name(F.col(label)).asc(), F.col("slug").asc()]
    best = top_k(scored, ["query"], order, 8, rank="_rank")
    return best.filter((F.col("_rank") <= 6) | (F.col("query") != "")).drop("_rank")


#: Queries which meet the names together; more are worked off in blocks of this many.
QUERY_BLOCK = 20_000


def _letters(t: Column) -> Column:
    """A bit for each letter of a text but blanks, several letters to a bit: what a text lacks here it lacks."""
    bits = F.transform(F.split(F.replace(t, F.lit(" "), F.lit("")), ""), lambda c: F.when(
        F.length(c) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(61)))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _ladder(t: Column, q: Column) -> Column:
    """``search_score`` for a query in a column: ``query``, its ``words`` and its ``letters`` without blanks."""
    def of_position(p: Column) -> Column:
        joined = F.replace(t, F.lit(" "), F.lit(""))
        place = F.aggregate(q["letters"], F.lit(0), lambda at, c: F.when(at < 0, at).otherwise(
            let(F.call_function("locate", c, joined, at + 1), lambda x: F.when(x > 0, x).otherwise(-1))))
        return (
            F.when(F.length(t) == 0, -1).when(t == q["query"], 1000)
            .when(p > 0, F.when(p == 1, 900).otherwise(F.lit(801) - p))
            .when(F.forall(q["words"], lambda w: F.contains(t, w)), F.lit(650) - F.length(t))
            .when(place >= 0, F.lit(500) - F.length(t)).otherwise(-1))

    return let(F.call_function("instr", t, q["query"]), of_position)


def _by_label() -> list[Column]:
    return [by_name(F.col("_label")).asc(), F.col("_slug").asc(), F.col("_id").asc()]


def _first_holders(names: DataFrame) -> DataFrame:
    """(text, _id, _label, _slug): of the names with a text the first 8 by label, for names (_id, _label, _slug, texts).

    A query scores a text, whoever has it, so a name with eight before it at its best text is behind those eight in any answer.
    """
    texts = F.transform(F.filter(F.array_distinct("texts"), lambda t: F.length(t) > 0), lambda t: F.struct(t.alias("text")))
    same = top_k(unfold(names, texts, "_id", "_label", "_slug"), ["text", "_label"], [F.col("_slug").asc(), F.col("_id").asc()], 8)
    return top_k(same, ["text"], _by_label(), 8)


def search_join(names: DataFrame, queries: DataFrame, folded: Sequence[str], label: str) -> DataFrame:
    """``search_names`` for any number of queries in a DataFrame (``query``, folded like the names): one plan for all.

    Queries go to every task in blocks of bounded size. Each distinct text of the names is scored once for a query, if it has all
    letters of the query, which every rung of the ladder needs and which is one comparison of bits; of the names with one
    text only the first 8 can answer. A name has the score of its best text. Best rows are cut inside the tasks. Repeated and
    null queries answer once or not at all; a blank query has the first names by label.
    """
    text = F.trim(F.regexp_replace("query", " +", " "))
    letters = F.filter(F.split(F.replace("query", F.lit(" "), F.lit("")), ""), lambda c: F.length(c) > 0)
    asked = bind(
        queries.filter(F.col("query").isNotNull()).select(text.alias("query")).distinct(), mask=_letters(F.col("query")), letters=letters,
        words=F.filter(F.split("query", " "), lambda w: F.length(w) > 0)).withColumn("q", F.struct("query", "words", "letters")).select("q", "mask")
    asked = cut_lineage(asked)
    blank = asked.filter("q.query = ''").select("q.query")
    asked = asked.filter("q.query <> ''")
    n = asked.count()
    kept = cut_lineage(names.select(*names.columns, F.monotonically_increasing_id().alias("_id")))
    plain = kept.select("_id", F.col(label).alias("_label"), F.col("slug").alias("_slug"), F.array(*folded).alias("texts"))
    holders = cut_lineage(_first_holders(plain))
    texts = cut_lineage(bind(holders.select("text").distinct(), own=_letters(F.col("text"))))
    blocks = -(-n // QUERY_BLOCK) or 1
    found = None
    for b in range(blocks):
        some = F.broadcast(asked.filter(F.pmod(F.xxhash64("q.query"), F.lit(blocks)) == b))
        met = texts.join(some, F.col("own").bitwiseAND(F.col("mask")) == F.col("mask"))
        rows = bind(met, score=_ladder(F.col("text"), F.col("q"))).filter(F.col("score") >= 0).select("text", F.col("q.query").alias("query"), "score")
        found = rows if found is None else found.unionByName(rows)
    best = found.join(holders, "text").groupBy("query", "_id").agg(
        F.max("score").alias("score"), F.first("_label").alias("_label"), F.first("_slug").alias("_slug"))
    best = top_k(best, ["query"], [F.col("score").desc(), *_by_label()], 8)
    blanks = plain.select("_id", "_label", "_slug", F.lit("").alias("query"), F.lit(1).alias("score"))
    first = top_k(blanks, ["query", "_label"], [F.col("_slug").asc(), F.col("_id").asc()], 6)
    first = top_k(first, ["query"], _by_label(), 6).join(F.broadcast(blank), "query", "left_semi")
    answers = best.select("_id", "query", "score").unionByName(first.select("_id", "query", "score"))
    return kept.join(answers, "_id").select(*names.columns, "query", "score")


# ---- discovery queries -----------------------------------------------------------------------
def distinct_ignoring_case(values: Column) -> Column:
    """Trimmed values without blanks, the first of those equal but for case."""
    cleaned = F.filter(F.transform(values, collapse_space), lambda v: F.length(v) > 0)
    return F.aggregate(
        cleaned,
        F.array().cast("array<string>"),
        lambda acc, v: F.when(
            F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc
        ).otherwise(F.concat(acc, F.array(v))),
    )


def role_queries(roles: DataFrame, maximum: int = rules.QUERIES_RUN) -> DataFrame:
    """Search texts per role: names, suffixed names, aliases and tasks; the first by priority.

    ``roles``: slug, name_en, name_zh, aliases, tasks (arrays). A role's few texts stay in its row.
    """
    built = F.concat(
        F.array(
            F.col("name_en"), F.col("name_zh"), F.concat("name_en", F.lit(" AI automation")),
            F.concat("name_en", F.lit(" copilot agent")),
        ),
        F.transform("aliases", lambda a: F.concat(a, F.lit(" AI"))),
        F.transform("tasks", lambda t: F.concat(t, F.lit(" AI"))),
    )
    first = roles.withColumn("_queries", F.slice(distinct_ignoring_case(built), 1, rules.QUERIES_BUILT))

    def priority(q: Column) -> Column:
        return (
            F.when(F.rlike(q, F.lit("(?i)ai automation")), 0)
            .when(F.rlike(q, F.lit("(?i) ai$")), 1)
            .otherwise(2)
        )

    ordered = F.slice(
        F.array_sort(F.transform("_queries", lambda q: F.struct(priority(q).alias("p"), q.alias("q")))),
        1, maximum,
    )
    return first.select(
        "slug", F.posexplode(ordered).alias("_i", "_q")
    ).select("slug", (F.col("_i") + 1).alias("query_rank"), F.col("_q.q").alias("query_text"))


# ---- import ----------------------------------------------------------------------------------
def import_dictionary(old: DataFrame, snapshot: DataFrame, position: str = "ordinal") -> DataFrame:
    """The next dictionary: snapshot rows active, others kept but inactive.

    ``snapshot`` may repeat a slug; the row written last stays.
    """
    fields = [c for c in old.columns if c not in ("slug", "is_active")]
    last = last_value_first_position(
        snapshot.select("slug", position, *fields), ["slug"], position
    ).select("slug", F.struct(*fields).alias("_new"))
    before = old.select("slug", F.struct(*fields).alias("_old"))
    merged = before.join(last, "slug", "full")
    return merged.select(
        "slug", F.coalesce("_new", "_old").alias("_r"), F.col("_new").isNotNull().alias("is_active")
    ).select("slug", "_r.*", "is_active")


def copy_names(state: DataFrame, dictionary: DataFrame) -> DataFrame:
    """State rows take the names of their active dictionary row."""
    names = dictionary.filter("is_active").select(
        "slug", F.col("name_en").alias("_en"), F.col("name_zh").alias("_zh")
    )
    return (
        state.join(names, "slug", "left")
        .withColumns({"name_en": F.coalesce("_en", "name_en"), "name_zh": F.coalesce("_zh", "name_zh")})
        .drop("_en", "_zh")
    )


# ---- exports ---------------------------------------------------------------------------------
def url_list(
    roles: DataFrame, site: str, locales: Sequence[str] = ("en", "zh"),
    topics: Sequence[str] = tuple(rules.TOPICS), pages: Sequence[str] = ("", "/methodology"),
) -> DataFrame:
    """Absolute URLs of fixed pages, topics and active roles in every locale, with alternates."""
    spark = roles.sparkSession
    fixed = spark.createDataFrame(
        [(p,) for p in [*pages, *[f"/topics/{t}" for t in topics]]], "path string"
    ).withColumn("last_modified", F.lit(None).cast("timestamp"))
    own = roles.filter("is_active").select(
        F.concat(F.lit("/roles/"), "slug").alias("path"), F.col("updated_at").alias("last_modified")
    )
    per_locale = F.explode(F.array(*[F.lit(loc) for loc in locales])).alias("locale")
    both = fixed.unionByName(own).select("path", "last_modified", per_locale)

    def absolute(locale: Column) -> Column:
        return F.concat(F.lit(site.rstrip("/") + "/"), locale, F.col("path"))

    return both.select(
        absolute(F.col("locale")).alias("url"), "last_modified",
        *[absolute(F.lit(loc)).alias(f"alternate_{loc}") for loc in locales],
        absolute(F.lit(locales[0])).alias("alternate_default"),
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Positions in one global order, for lists which are bounded already."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
