"""URL parsing, canonical form, host tests and page-type tests as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.bind import bind, let
from tidemark.functions.text import any_term, trim_all

# scheme, user info, host, port, path, query with its mark, fragment with its mark
_URL = (
    r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#@: \t\n\x0B\f\r<>^|%\[\]]+)(?::(\d*))?"
    r"(/[^?#]*)?(\?[^#]*)?(#.*)?$"
)
_BARE_HOST = (
    r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#@: \t\n\x0B\f\r<>^|%\[\]]+)(?::\d*)?(?:[/?#].*)?$"
)
_TRACKING_KEY = r"^(?i)(utm_[^=]*|spm|from|ref)(=|$)"
TRACKING_QUERY_PATTERN = _TRACKING_KEY
URL_PATTERN = _URL


_SPLIT = "\x1f"


def _parts(u: Column) -> Column:
    """Scheme, user, host, port, path, query, fragment as an array of seven; one element if invalid."""
    marked = F.regexp_replace(trim_all(u), _URL, _SPLIT.join(f"${i}" for i in range(1, 8)))
    return F.split(marked, _SPLIT)


def _is_whole(p: Column) -> Column:
    return F.size(p) == 7


def is_valid(u: Column) -> Column:
    return F.coalesce(F.rlike(trim_all(u), F.lit(_URL)), F.lit(False))


def full_host(u: Column) -> Column:
    """Lower-case host, NULL where the text is no absolute URL."""
    return F.nullif(F.lower(F.regexp_extract(trim_all(u), _URL, 3)), F.lit(""))


def _bare_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(trim_all(u), _BARE_HOST, 1))


def host(u: Column) -> Column:
    """Lower-case host without a leading ``www.``, NULL where the text is no absolute URL."""
    return F.nullif(_bare_host(u), F.lit(""))


def is_public(u: Column) -> Column:
    return F.coalesce(~_bare_host(u).isin("", "example.com"), F.lit(False))


def mentions_example(u: Column) -> Column:
    """The substring test, anywhere in the URL, ASCII case ignored."""
    return F.contains(F.lower(u), F.lit("example.com"))


def _remove_dot_segments(path: Column) -> Column:
    parts = F.split(F.substring(path, 2, 2_000_000_000), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


#: Signs which URL parsers print escaped, besides controls and all beyond ASCII; escapes that stand already stay.
_PATH_SIGNS, _QUERY_SIGNS, _FRAGMENT_SIGNS = ' "<>^`{}', " \"<>'", ' "<>`'


def percent_encoded(text: Column, signs: str) -> Column:
    """Escapes the UTF-8 bytes of given signs, controls and letters beyond ASCII."""
    group = "(?s)(?![\\x21-\\x7e]).|[" + "".join("\\" + s for s in signs) + "]"

    def one(c: Column) -> Column:
        hexed = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"%$1")
        return F.when(F.rlike(c, F.lit(group)), hexed).otherwise(c)

    def escaped(t: Column) -> Column:
        letters = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
        return F.when(F.rlike(t, F.lit(group)), F.array_join(F.transform(letters, one), "")).otherwise(t)

    return let(text, escaped)


def normal_path(path: Column) -> Column:
    """A path as URL parsers print it: dot segments resolved, reserved and non-ASCII signs escaped, never empty."""
    def dotless(escaped: Column) -> Column:
        dotted = F.rlike(escaped, F.lit(r"/\.\.?(/|$)"))
        return (
            F.when(F.length(escaped) == 0, F.lit("/"))
            .when(dotted, _remove_dot_segments(escaped))
            .otherwise(escaped)
        )

    return let(percent_encoded(path, _PATH_SIGNS), dotless)


def _assemble(p: Column, host_text: Column, query: Column) -> Column:
    scheme, port = F.lower(p[0]), p[3]
    default_port = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.concat(
        scheme,
        F.lit("://"),
        F.when(F.length(p[1]) > 0, F.concat(p[1], F.lit("@"))).otherwise(""),
        host_text,
        F.when((F.length(port) > 0) & ~default_port, F.concat(F.lit(":"), port)).otherwise(""),
        let(p[4], normal_path),
        percent_encoded(query, _QUERY_SIGNS),
        percent_encoded(p[6], _FRAGMENT_SIGNS),
    )


def printed(u: Column) -> Column:
    """An absolute URL as parsers print it back, NULL where invalid."""
    return let(_parts(u), lambda p: F.when(_is_whole(p), _assemble(p, F.lower(p[2]), p[5])))


def _without_tracking(query: Column) -> Column:
    def rebuilt(pairs: Column) -> Column:
        kept = F.filter(pairs, lambda q: ~F.rlike(q, F.lit(_TRACKING_KEY)))
        parts = F.array_join(F.filter(kept, lambda q: F.length(q) > 0), "&")
        marked = F.when(F.length(parts) > 0, F.concat(F.lit("?"), parts)).otherwise("")
        return F.when(F.size(kept) == F.size(pairs), query).otherwise(marked)

    return let(F.split(F.substring(query, 2, 2_000_000_000), "&"), rebuilt)


def canonical(u: Column) -> Column:
    """Key form: no ``www.``, no tracking parameters; text which is no URL stays as it is."""

    def of_parts(p: Column) -> Column:
        bare = F.regexp_replace(F.lower(p[2]), r"^www\.", "")
        return F.when(_is_whole(p), _assemble(p, bare, _without_tracking(p[5])))

    return F.coalesce(let(_parts(u), of_parts), u)


def path_of(u: Column) -> Column:
    return F.regexp_extract(trim_all(u), _URL, 5)


def query_value(u: Column, key: str) -> Column:
    """Decoded value of one query parameter, NULL where absent."""
    raw = F.regexp_extract(F.regexp_extract(trim_all(u), _URL, 6), rf"[?&]{key}=([^&]*)", 1)
    return F.when(F.length(raw) > 0, F.try_url_decode(raw))


def resolve(link: Column, base: Column) -> Column:
    """A link against the page it stands on, NULL where neither gives an absolute URL."""

    def on_base(t: Column, p: Column) -> Column:
        scheme = F.lower(p[0])
        origin = F.concat(
            scheme, F.lit("://"), F.lower(p[2]),
            F.when(F.length(p[3]) > 0, F.concat(F.lit(":"), p[3])).otherwise(""),
        )
        base_path = normal_path(p[4])
        return printed(
            F.when(F.length(t) == 0, F.concat(origin, base_path, p[5]))
            .when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
            .when(F.startswith(t, F.lit("/")), F.concat(origin, t))
            .when(F.startswith(t, F.lit("?")), F.concat(origin, base_path, t))
            .when(F.startswith(t, F.lit("#")), F.concat(origin, base_path, p[5], t))
            .otherwise(F.concat(origin, F.regexp_replace(base_path, "[^/]*$", ""), t))
        )

    def of_text(t: Column) -> Column:
        scheme = F.regexp_extract(t, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:(?://)?", 0)
        return (
            F.when(F.endswith(scheme, F.lit("://")), printed(t))
            .when(F.length(scheme) > 0, t)
            .otherwise(let(_parts(base), lambda p: F.when(_is_whole(p), on_base(t, p))))
        )

    return let(trim_all(link), of_text)


# ---- page types of search hits ---------------------------------------------------------------
def page_parts(u: Column) -> Column:
    """Host and path segments of a URL, NULL if invalid; bind it, the page tests read it often."""

    def of_parts(p: Column) -> Column:
        segments = F.filter(F.split(normal_path(p[4]), "/"), lambda s: F.length(s) > 0)
        return F.when(_is_whole(p), F.struct(F.lower(p[2]).alias("host"), segments.alias("segments")))

    return let(_parts(u), of_parts)


def with_page_types(df: DataFrame, url: Column, title: Column, published: Column) -> DataFrame:
    """Adds ``landing``, ``evergreen``, ``reference`` and ``vertical``; all false for an invalid URL.

    ``published`` is NULL or empty where the hit has no date.
    """
    first = bind(
        df, _page=page_parts(url), _lower_title=F.lower(title),
        _undated=published.isNull() | (F.length(published) == 0),
    )
    segments = F.col("_page.segments")
    names = F.transform(segments, F.lower)
    ready = bind(
        first, _depth=F.size(segments), _names=names, _host=F.col("_page.host"),
        _path=F.concat(F.lit("/"), F.array_join(segments, "/")),
        _marketing=any_term(F.col("_lower_title"), rules.MARKETING_TITLE_TERMS),
    )
    undated, depth, title_text = F.col("_undated"), F.col("_depth"), F.col("_lower_title")

    def has_segment(wanted: Iterable[str]) -> Column:
        return F.arrays_overlap("_names", F.array(*[F.lit(w) for w in wanted]))

    locale_only = (depth == 1) & F.rlike(
        F.coalesce(F.try_element_at("_names", F.lit(1)), F.lit("")), F.lit(r"^[a-z]{2}(-[a-z]{2})?$")
    )
    known_host = F.lit(False)
    for name in rules.REFERENCE_HOSTS:
        known_host = known_host | (F.col("_host") == name) | F.endswith("_host", F.lit("." + name))
    timeless = any_term(title_text, rules.EVERGREEN_TITLE_TERMS) & ~has_segment(rules.ARTICLE_SEGMENTS)

    def flag(c: Column) -> Column:
        return F.coalesce(F.col("_page").isNotNull() & c, F.lit(False))

    return ready.withColumns(
        {
            "landing": flag(
                F.col("_path").isin(*rules.LANDING_PATHS) | locale_only
                | (undated & (depth <= 1) & F.col("_marketing"))
            ),
            "evergreen": flag(undated & ((depth <= 1) | timeless)),
            "reference": flag(undated & (any_term(title_text, rules.REFERENCE_TITLE_TERMS) | known_host)),
            "vertical": flag(undated & has_segment(rules.VERTICAL_SEGMENTS) & F.col("_marketing")),
        }
    ).drop("_page", "_lower_title", "_undated", "_depth", "_names", "_host", "_path", "_marketing")
