"""Normalisers, tokenisers, keyword building and text gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import hashing, html, text
from tidemark.workload.registry import Inputs, query

SPACE_SQL = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
STOP_SQL = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)


@query("P5_normalisers", f"""
select doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) as folded,
       md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))) as kept,
       md5(trim(regexp_replace(text, '{SPACE_SQL}', ' ', 'g'))) as collapsed,
       md5(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))) as trimmed
from documents""")
def p5(t: Inputs):
    c = F.col("text")
    return t.documents.select(
        "doc_id",
        F.md5(text.fold_ascii(c)).alias("folded"),
        F.md5(text.fold_keep_space(c)).alias("kept"),
        F.md5(text.collapse_space(c)).alias("collapsed"),
        F.md5(text.trim_lower(c)).alias("trimmed"),
    )


# letters with marks in the four languages of the texts: base letter, then the mark as a gap
_MARKED = {"a": "áàâäã", "e": "éèêë", "i": "íìîï", "o": "óòôöõ", "u": "úùûü", "n": "ñ", "c": "ç"}
_UNMARKED = "lower(text)"
for _base, _letters in _MARKED.items():
    _UNMARKED = f"regexp_replace({_UNMARKED}, '[{_letters}]', '{_base} ', 'g')"


@query("P6_unicode_fold", f"""
select doc_id, md5(trim(regexp_replace({_UNMARKED}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) as folded from documents""")
def p6(t: Inputs):
    return t.documents.select("doc_id", F.md5(text.fold_unicode(F.col("text"))).alias("folded"))


@query("P7_tokens", f"""
select doc_id, len(tok) as n, md5(array_to_string(tok, ' ')) as digest from (
  select doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '),
         lambda x: length(x) > 2 and x not in ({STOP_SQL})) as tok from documents)""")
def p7(t: Inputs):
    tok = t.documents.select("doc_id", text.tokens(F.col("text")).alias("tok"))
    return tok.select(
        "doc_id", F.size("tok").cast("long").alias("n"), F.md5(F.array_join("tok", " ")).alias("digest")
    )


@query("P8_slugify", """
select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(concat(p_name, ' & (', p_type, ')')),
         '&', ' and ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug
from part""")
def p8(t: Inputs):
    name = F.concat("p_name", F.lit(" & ("), "p_type", F.lit(")"))
    return t.part.select("p_partkey", text.slugify(name).alias("slug"))


KEYWORD_SQL = """list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]+', ' ', 'g'),
    '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 2)"""


@query("P9_keywords", f"""
with k as (select doc_id, {KEYWORD_SQL.format(c='text')} as w from documents),
u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from k),
f as (select doc_id, x, min(i) as i from u group by doc_id, x),
r as (select *, row_number() over (partition by doc_id order by i) as rn from f)
select doc_id, string_agg(x, ' ' order by i) as keywords from r where rn <= 8 group by doc_id""")
def p9(t: Inputs):
    words = t.documents.select("doc_id", text.build_keywords(F.col("text")).alias("k"))
    return words.filter(F.size("k") > 0).select("doc_id", F.array_join("k", " ").alias("keywords"))


ALIASES_FX = {"ring": ("rings", "circle"), "part": ("parts", "piece"), "plate": ("dish",)}


@query("P10_term_expansion", """
with k as (select slug, unnest([kw_text, concat(kw_text, 's'), 'parties of ' || name_en]) as kw from fx_role),
n as (select slug, trim(lower(kw)) as kw from k),
tk as (select slug, unnest(string_split(kw, ' ')) as tok from n),
sg as (select slug, tok, case when length(tok) > 4 and tok like '%ies' then tok[:-4] || 'y'
         when length(tok) > 4 and tok like '%s' then tok[:-2] else tok end as one from tk),
al as (select * from (values ('ring', 'rings'), ('ring', 'circle'), ('part', 'parts'), ('part', 'piece'),
         ('plate', 'dish')) v(a, b)),
a as (select slug, kw as term from n union select slug, tok from sg union select slug, one from sg
      union select slug, b from sg join al on sg.tok = al.a union select slug, b from sg join al on sg.one = al.a)
select slug, count(*) as n, string_agg(term, '|' order by term) as terms from a group by slug""")
def p10(t: Inputs):
    kw = F.array("kw_text", F.concat("kw_text", F.lit("s")), F.concat(F.lit("parties of "), "name_en"))
    terms = t.fx_role.select("slug", text.expand_terms(kw, ALIASES_FX).alias("terms"))
    return terms.select(
        "slug", F.size("terms").cast("long").alias("n"),
        F.array_join(F.array_sort("terms"), "|").alias("terms"),
    )


@query("P25_content_hash", f"""
with x as (select doc_id, lang, source, trim(regexp_replace(text, '{SPACE_SQL}', ' ', 'g')) as t from documents)
select doc_id, sha256(concat('{{"lang":"', lang, '","text":"', replace(replace(t, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '"}}')) as hash,
   sha256(concat('{{"slug":"', lang, '","provider":"p","query":"', source, ' jobs"}}')) as query_hash from x""")
def p25(t: Inputs):
    h = hashing.stable_hash(F.col("lang"), text.collapse_space(F.col("text")).alias("text"))
    q = hashing.query_hash(F.col("lang"), F.lit("p"), F.concat("source", F.lit("  jobs ")))
    return t.documents.select("doc_id", h.alias("hash"), q.alias("query_hash"))


FX_NOISE = ("the and", "thand", "onan", "lles")
FX_WORKFLOW = ("ring", "ende", "tion", "est")


def _gate_sql(terms) -> str:
    return r"(?i)\b(" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b"


@query("P39_text_gates", f"""
select doc_id, regexp_matches(text, '{_gate_sql(FX_NOISE)}') as noisy,
       regexp_matches(text, '{_gate_sql(FX_WORKFLOW)}') as workflow,
       regexp_matches(text, '{_gate_sql(rules.BROAD_NOISE_TERMS)}') as broad,
       regexp_matches(text, '{_gate_sql(rules.WORKFLOW_TERMS)}') as concrete
from documents""")
def p39(t: Inputs):
    c = F.col("text")
    return t.documents.select(
        "doc_id", text.has_broad_noise(c, FX_NOISE).alias("noisy"),
        text.has_workflow_language(c, FX_WORKFLOW).alias("workflow"),
        text.has_broad_noise(c).alias("broad"), text.has_workflow_language(c).alias("concrete"),
    )


RANK_FX = ((r"\bthe\b|\bdie\b", 7), (r"\bring(s)?\b", 5), (r"\bque\b", -4), (r"tion", 2))


@query("X14_rank_rules", """
select *, row_number() over (partition by source order by score desc, day desc, cast(doc_id as varchar)) as relevance_rank from (
select doc_id, source, cast(date '2024-01-01' + cast(doc_id % 28 as int) as varchar) as day,
   case when regexp_matches(lower(text), '\\bthe\\b|\\bdie\\b') then 7 else 0 end
   + case when regexp_matches(lower(text), '\\bring(s)?\\b') then 5 else 0 end
   + case when regexp_matches(lower(text), '\\bque\\b') then -4 else 0 end
   + case when regexp_matches(lower(text), 'tion') then 2 else 0 end as score from documents)""")
def x14(t: Inputs):
    from tidemark.sources.listing import by_relevance

    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("string")
    items = t.documents.select(
        "doc_id", "source", F.col("lang").alias("title"), F.col("text").alias("summary"), day.alias("published_at"),
        F.col("doc_id").cast("string").alias("source_url"))
    return by_relevance(items, ["source"], RANK_FX).select(
        "doc_id", "source", F.col("published_at").alias("day"), "score", F.col("relevance_rank").cast("long").alias("relevance_rank"))


@query("P42_email_key", "select c_custkey, lower(trim(concat('  ', c_name, '@Mail.test '))) as email from customer")
def p42(t: Inputs):
    return t.customer.select(
        "c_custkey", text.trim_lower(F.concat(F.lit("  "), "c_name", F.lit("@Mail.test "))).alias("email")
    )


@query("P45_translation", """
with tr as (select concat(p_name, ' x') as k, p_name, row_number() over (partition by p_name order by p_partkey) as rn from part),
m as (select p_name as name_en, concat(upper(p_name), '!') as name_zh from tr where rn = 1 and p_name < 'm')
select p.p_partkey, coalesce(m.name_zh, p.p_name) as name from part p left join m on p.p_name = m.name_en""")
def p45(t: Inputs):
    from tidemark.sources.dictionary import translated

    names = t.part.select("p_name").distinct().filter(F.col("p_name") < "m")
    translations = names.select(
        F.col("p_name").alias("name_en"), F.concat(F.upper("p_name"), F.lit("!")).alias("name_zh")
    )
    roles = t.part.select("p_partkey", F.col("p_name").alias("name_en"))
    return translated(roles, translations).select("p_partkey", F.col("name_zh").alias("name"))


@query("P11_strip_markup", r"""
select page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html,
   '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '),
   '<[^>]+>', ' ', 'g'), '[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))) as digest
from pages""")
def p11(t: Inputs):
    return t.pages.select("page_id", F.md5(html.strip(F.col("html"))).alias("digest"))
