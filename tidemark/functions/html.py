"""Markup fragments: entities, tags, attributes and the date in a card."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions.bind import let
from tidemark.functions.text import SPACE, ascii_bounds, collapse_space, term_pattern, trim_all

# entity, character; applied in this order
_ENTITIES = (
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
)
# a look at the first letter spares most places the look behind it
DATE_TEXT = r"(?=[A-Z\d])(?<!\w)" + ascii_bounds(
    r"([A-Z][a-z]{2,8}\s+\d{1,2},\s+\d{4}|\d{4}-\d{2}-\d{2}(?:T[0-9:.+\-Z]+)?)\b"
)
ANCHOR = r"(?is)<a\b[^>]*href=[\"'][^\"']+[\"'][^>]*>(.*?)</a>"


def decode(c: Column, nbsp: bool = True) -> Column:
    out = c
    for entity, char in _ENTITIES if nbsp else _ENTITIES[:-1]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def drop_tags(c: Column) -> Column:
    return collapse_space(F.regexp_replace(c, "<[^>]+>", " "))


def strip(c: Column) -> Column:
    """Entities decoded first, then tags dropped, then white space collapsed."""
    return drop_tags(decode(c))


def non_empty(c: Column) -> Column:
    return let(c, lambda v: F.when(F.length(v) > 0, v))


def extract(fragment: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, NULL where the pattern does not match; the fragment is searched once.

    Patterns match at least one character, and what they match does not depend on the text around it.
    """
    def of_match(m: Column) -> Column:
        return F.when(F.length(m) > 0, m if group == 0 else F.regexp_extract(m, pattern, group))

    return let(F.regexp_extract(fragment, pattern, 0), of_match)


def attribute(fragment: Column, tag: str, name: str) -> Column:
    """Trimmed attribute value, empty where there is none."""
    pattern = rf"(?i)<{tag}\b[^>]*{name}=[\"']([^\"']+)[\"'][^>]*>"
    return trim_all(F.regexp_extract(fragment, pattern, 1))


def any_attribute(fragment: Column, names: Iterable[str]) -> Column:
    return F.coalesce(
        *[non_empty(trim_all(F.regexp_extract(fragment, rf"(?i)<[^>]+{n}=[\"']([^\"']+)[\"'][^>]*>", 1))) for n in names]
    )


def first_body(fragment: Column, tags: Iterable[str]) -> Column:
    """Text of the first tag kind that occurs; an empty body still counts as found."""
    return F.coalesce(
        *[strip(extract(fragment, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>")) for t in tags]
    )


def all_bodies(fragment: Column, tags: Iterable[str]) -> Column:
    """Texts of all occurrences, tag kind by tag kind, empty ones dropped."""
    found = [
        F.regexp_extract_all(fragment, F.lit(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), F.lit(1)) for t in tags
    ]
    return F.filter(F.transform(F.concat(*found), strip), lambda b: F.length(b) > 0)


def anchor_title(fragment: Column, headings: Iterable[str] = ("h1", "h2", "h3")) -> Column:
    return let(extract(fragment, ANCHOR), lambda body: F.coalesce(first_body(body, headings), strip(body)))


def date_text(fragment: Column) -> Column:
    return non_empty(F.regexp_extract(fragment, DATE_TEXT, 1))


def published_text(fragment: Column) -> Column:
    """``datetime`` attribute, else the body of ``<time>``, else the first date-shaped text."""
    return F.coalesce(
        non_empty(attribute(fragment, "time", "datetime")),
        non_empty(first_body(fragment, ["time"])),
        date_text(fragment),
    )


def clean_title(c: Column) -> Column:
    """Without a trailing "Tag:" list; NULL stays NULL."""
    # not by ``split``, which compiles its pattern for every row
    return collapse_space(F.regexp_replace(c, rf"(?is)(?![!-~]){SPACE}+Tag:{SPACE}.*", ""))


def is_promotional(fragment: Column, title: Column) -> Column:
    text = F.lower(F.concat(fragment, F.lit(" "), F.coalesce(title, F.lit(""))))
    return F.rlike(text, F.lit(term_pattern(rules.PROMO_TERMS)))


def label_value(text: Column, label: str) -> Column:
    """The value after ``Label:`` up to a bullet, bar or line end."""
    return trim_all(extract(text, ascii_bounds(rf"(?i)\b{label}\b\s*[:\-]?\s*([^•|\n]+)")))
