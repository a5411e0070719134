"""Text normalisers, tokenisers and term expansion as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import rules

# white space as browsers and scripting engines see it, a superset of the regex class \s
SPACE = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


_SPACE_CHARS = (
    " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE_CHARS))


#: Runs of white space other than one blank. Printable ASCII, blanks included, is told by one comparison. No range is
#: negated: where one class of a pattern is both negated and part of a union, the JVM's type checks of parallel tasks contend.
_RUNS = rf" *+(?![ -~]){SPACE}{SPACE}*+| {{2,}}+"


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends; single blanks between words are not rewritten."""
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def by_name(c: Column) -> Column:
    """A name as it sorts for readers: letters before case and accents, not by bytes."""
    return F.collate(c, "UNICODE")


def fold_ascii(c: Column) -> Column:
    """Lower case; every run of other than ASCII letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def fold_keep_space(c: Column) -> Column:
    """As ``fold_ascii`` but written as two steps, white space kept until the collapse."""
    dropped = F.regexp_replace(F.lower(c), r"[^a-z0-9\s]+", " ")
    return F.trim(F.regexp_replace(dropped, r"\s+", " "))


def trim_lower(c: Column) -> Column:
    return F.lower(trim_all(F.coalesce(c, F.lit(""))))


@F.pandas_udf(T.StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def fold_unicode(c: Column) -> Column:
    """NFKD, letters and digits of any script kept. Arrow batches: Spark has no normaliser."""
    return F.trim(F.regexp_replace(_nfkd(F.lower(c)), r"[^\p{L}\p{N}]+", " "))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: F.length(t) > 0)


def tokens(c: Column) -> Column:
    """Folded words longer than two characters without stop words, duplicates kept."""
    stop = F.array(*[F.lit(w) for w in rules.STOP_WORDS])
    return F.filter(
        F.split(fold_ascii(c), " "),
        lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t),
    )


def slugify(c: Column) -> Column:
    spelled = F.regexp_replace(F.lower(c), "&", " and ")
    dashed = F.regexp_replace(spelled, "[^a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "^-+|-+$", ""), "-{2,}", "-")


def build_keywords(c: Column, keep: int = 8) -> Column:
    words = F.filter(F.split(fold_keep_space(c), " "), lambda t: F.length(t) > 2)
    return F.slice(F.array_distinct(words), 1, keep)


def _alias_map(aliases: Mapping[str, Iterable[str]]) -> Column:
    pairs: list[Column] = []
    for term, others in aliases.items():
        pairs += [F.lit(term), F.array(*[F.lit(o) for o in others])]
    return F.create_map(*pairs)


def singular(t: Column) -> Column:
    long_enough = F.length(t) > 4
    return (
        F.when(long_enough & F.endswith(t, F.lit("ies")), F.regexp_replace(t, "ies$", "y"))
        .when(long_enough & F.endswith(t, F.lit("s")), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def expand_terms(keywords: Column, aliases: Mapping[str, Iterable[str]] = rules.TERM_ALIASES) -> Column:
    """Each keyword, its words, their singulars and the aliases of both; distinct."""
    known = _alias_map(aliases)
    empty = F.array().cast("array<string>")

    def of_token(t: Column) -> Column:
        one = singular(t)
        return F.concat(
            F.array(t, one),
            F.coalesce(F.try_element_at(known, t), empty),
            F.coalesce(F.try_element_at(known, one), empty),
        )

    def of_keyword(k: Column) -> Column:
        words = F.split(k, r"\s+")
        return F.concat(F.array(k), F.flatten(F.transform(words, of_token)))

    cleaned = F.filter(
        F.transform(keywords, lambda k: trim_all(F.lower(k))), lambda k: F.length(k) > 0
    )
    return F.array_distinct(F.flatten(F.transform(cleaned, of_keyword)))


def any_term(c: Column, terms: Iterable[str]) -> Column:
    """True when the text holds any of the terms as a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(c, F.lit(term))
    return found


_W = r"\w"


def ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds which know ASCII letters, digits and ``_`` only."""
    return pattern.replace(r"\b", f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))")


def term_pattern(terms: Iterable[str]) -> str:
    """A pattern for any of the terms as whole words, longest first.

    Where all terms are plain words, a look at the next letter spares most places the rest.
    """
    ordered = sorted(terms, key=len, reverse=True)
    plain = ordered and all(re.fullmatch("[a-z][a-z0-9 -]*", t) for t in ordered)
    first = f"(?=[{''.join(sorted({t[0] for t in ordered}))}])" if plain else ""
    return f"(?i){first}(?<!{_W})(?:" + "|".join(ordered) + f")(?!{_W})"


def has_broad_noise(text: Column, terms: Iterable[str] = rules.BROAD_NOISE_TERMS) -> Column:
    return F.rlike(text, F.lit(term_pattern(terms)))


def has_workflow_language(text: Column, terms: Iterable[str] = rules.WORKFLOW_TERMS) -> Column:
    return F.rlike(text, F.lit(term_pattern(terms)))
