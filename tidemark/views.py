"""Inputs of the registered queries: the shared tables in the shapes the operators expect.

Each view is one portable statement, used as it stands by Spark and, as a common table expression,
by the SQL the results are compared with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "pages", "labels",
)

VIEWS = {
    # role dictionary
    "fx_role": """
        select concat('r', cast(p_partkey as string)) as slug, p_name as name_en,
               case when p_partkey % 4 = 0 then p_name else concat(p_name, '-zh') end as name_zh,
               p_brand as industry_code, lower(concat(p_name, ' ', p_type)) as kw_text,
               p_partkey % 10 <> 9 as is_active,
               cast(cast('2024-01-01' as date) + p_size as timestamp) as updated_at
        from {part}""",
    # scored state: part of the dictionary, plus rows which are not in it
    "fx_state": """
        select concat('r', cast(p_partkey as string)) as slug, p_name as name_en,
               concat(p_name, '-zh') as name_zh,
               case when p_partkey % 5 = 0 then null
                    else cast(least(95, greatest(5, p_size * 2 - 3)) as int) end as replacement_rate,
               case when p_size >= 42 then 'SEVERE' when p_size >= 29 then 'HIGH'
                    when p_size >= 17 then 'MEDIUM' else 'LOW' end as risk_level,
               case when p_partkey % 5 = 0 then 'INSUFFICIENT_SIGNAL' else 'RATED' end as rating_status,
               case when p_size % 3 = 0
                    then 'No role-specific source items are attached yet, so this is a guess.'
                    when p_size % 3 = 1 then concat('Summary of ', p_name) end as risk_summary_en,
               case when p_size % 3 = 0
                    then '这个岗位当前结合了 0 条近期来源信号。'
                    when p_size % 3 = 1 then concat('关于 ', p_name) end as risk_summary_zh,
               cast(cast('2024-01-01' as date) + p_size as timestamp) as last_rated_at,
               case when p_size % 4 = 0 then null
                    else cast(cast('2024-01-02' as date) + p_size as timestamp) end as risk_cached_at,
               p_size % 6 as s_repetition, p_size % 5 as s_rules, p_size % 4 as s_transformation,
               p_size % 3 as s_workflow, p_size % 2 as s_interpersonal, p_size % 5 as s_physical,
               p_size % 4 as s_ambiguity
        from {part} where p_type not in ('PROMO', 'LARGE')
        union all
        select concat('s', cast(s_suppkey as string)), lower(s_name), lower(s_name),
               cast(floor(least(95, greatest(5, s_acctbal / 100))) as int), 'MEDIUM', 'RATED',
               null, null, cast('2024-03-01' as timestamp), null, 1, 1, 1, 1, 1, 1, 1
        from {supplier}""",
    # classified evidence with its decision
    "fx_evidence": """
        select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                         cast(l_partkey as string), cast(l_suppkey as string),
                         cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string)) as item_id,
               concat('r', cast(l_partkey as string)) as role_slug,
               case l_suppkey % 4 when 0 then 'COMPANY_UPDATE' when 1 then 'BLOG'
                    when 2 then 'NEWS' else 'JOB_POSTING' end as source_type,
               case when l_suppkey % 5 = 0 then 'discovery-x' else 'catalog-x' end as source_catalog_id,
               case l_returnflag when 'A' then 'HIGH' when 'N' then 'MEDIUM' else 'LOW' end as relevance,
               case when l_linestatus = 'O' then 'INCREASE'
                    when l_linenumber % 2 = 0 then 'DECREASE' else 'MAINTAIN' end as impact,
               l_discount * 10 as signal_weight, l_shipdate as published_at,
               concat('https://', case l_suppkey % 3 when 0 then 'www.' else '' end,
                      case when l_suppkey % 7 = 0 then 'example.com' when l_suppkey % 7 = 1
                           then 'notexample.com' else 'news.test' end,
                      '/a/', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-',
                      cast(l_suppkey as string)) as source_url,
               case l_linenumber % 5
                    when 0 then '{{"signalType": " adoption_case "}}'
                    when 1 then '{{"signalType": "other", "value": "HIRING_SHIFT"}}'
                    when 2 then '{{"strategyCanAffectReplacementRate": false}}'
                    when 3 then '{{"strategyCanAffectReplacementRate": "false", "sourceValue": 3}}'
               end as raw_json,
               case l_linenumber % 4 when 0 then 'UNMATCHED' when 1 then 'AMBIGUOUS'
                    else 'ACCEPTED' end as decision_status,
               case when l_linenumber % 3 = 0 then null when l_linenumber % 3 = 1
                    then concat('r', cast(l_partkey as string))
                    else concat('r', cast(l_suppkey as string)) end as decision_slug,
               case l_suppkey % 3 when 0 then 'PENDING' when 1 then 'APPROVED'
                    else 'REJECTED' end as review_status,
               concat('Title ', cast(l_suppkey as string)) as title,
               concat('Summary ', cast(l_orderkey as string)) as summary_en,
               case when l_linenumber % 2 = 0 then concat('Inferred ', cast(l_partkey as string))
               end as inference_summary_en
        from {lineitem}""",
    # score history
    "fx_snapshot": """
        select event_id as snapshot_id, user_id as role_id, ts as snapshot_at,
               case when event_type = 'error' then null
                    else cast(floor(least(95, greatest(5, value)) + 0.5) as int) end as rate
        from {events}""",
    # subscriptions, one per email and role
    "fx_sub": """
        select concat(' User', cast(o_custkey as string), '@Mail.test ') as email,
               concat('r', cast(o_orderkey % 2000 as string)) as slug,
               min(o_orderdate) as created_at,
               case when o_custkey % 3 = 0 then cast('2024-05-20' as timestamp)
                    when o_custkey % 3 = 1 then cast('2024-05-30' as timestamp) end as last_digest_at,
               case when o_orderkey % 2000 % 4 = 0 then cast('2024-01-20' as timestamp) end as last_alert_at,
               case when o_orderkey % 2000 % 7 = 0 then null
                    else cast(o_orderkey % 2000 % 90 as int) end as last_alert_rate
        from {orders} group by o_custkey, o_orderkey % 2000""",
    # notifications which wait already
    "fx_pending": """
        select concat('user', cast(c_custkey as string), '@mail.test') as email,
               case when c_nationkey % 2 = 0 then 'WEEKLY_DIGEST' else 'SIGNIFICANT_CHANGE' end as kind,
               case when c_nationkey % 2 = 0 then null
                    else concat('r', cast(c_custkey % 2000 as string)) end as slug,
               case when c_mktsegment = 'BUILDING' then 'PENDING' else 'SENT' end as status,
               c_custkey as dispatch_id
        from {customer}""",
    # raw source items, whole texts
    "fx_item": """
        select doc_id as item_id, concat('src', cast(doc_id % 7 as string)) as source_catalog_id,
               concat('https://news.test/', source, '/', cast(doc_id as string)) as source_url,
               case doc_id % 4 when 0 then 'COMPANY_UPDATE' when 1 then 'BLOG'
                    when 2 then 'NEWS' else 'JOB_POSTING' end as source_type,
               substr(text, 1, 80) as title, substr(text, 81) as summary,
               concat(lang, ' ', source) as hint_text, lang, source,
               cast(cast('2024-01-01' as date) + cast(doc_id % 365 as int) as timestamp) as published_at
        from {documents}""",
    # fetched pages, and each once more with a tracking parameter under another source
    "fx_fetch": """
        select page_id as idx, page_id % 5 as source_ord, url as source_url,
               concat(' page ', cast(page_id as string), ' ') as title,
               case when page_id % 97 = 96 then 'soon' else '2024-05-01T10:00:00Z' end as published
        from {pages}
        union all
        select page_id + 1000000000, 5 + page_id % 2,
               case when instr(url, '#') > 0 then url
                    when instr(url, '?') > 0 then concat(url, '&utm_medium=x')
                    else concat(url, '?utm_medium=x') end,
               concat('again ', cast(page_id as string)), 'May 3, 2024'
        from {pages}
        union all
        select page_id + 2000000000, page_id % 5, url, concat('late ', cast(page_id as string)),
               '2024-05-02'
        from {pages}""",
    # search hits per role
    "fx_hit": """
        select concat('r', cast(l_partkey as string)) as role_slug,
               concat('https://', case l_suppkey % 5 when 0 then 'www.bls.gov' when 1 then 'blog.test'
                      when 2 then 'vendor.test' else 'press.test' end,
                      case l_suppkey % 6 when 0 then '/' when 1 then '/en-us'
                           when 2 then '/industry/' when 3 then '/news/'
                           else '/a/b/' end,
                      case when l_suppkey % 6 < 2 then ''
                           else concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) end
                     ) as url,
               concat(case l_linenumber % 3 when 0 then upper(p_name) else 'Someone' end,
                      case l_returnflag when 'A' then ' uses AI agents'
                           when 'N' then ' and the future of work' else ' platform raises funding' end) as title,
               concat(case l_linenumber % 2 when 0 then p_name else 'plain' end,
                      case l_linestatus when 'O' then ' ticket triage' else ' text' end) as snippet,
               case when l_linenumber % 4 = 0 then null when l_linenumber % 4 = 1 then 'not a date'
                    else cast(cast(l_shipdate as date) as string) end as published,
               l_linenumber as rank,
               concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
                         cast(l_partkey as string), cast(l_suppkey as string),
                         cast(cast(floor(l_extendedprice * 100 + 0.5) as bigint) as string)) as hit_id
        from {lineitem} join {part} on l_partkey = p_partkey""",
    # request log
    "fx_auth_event": """
        select event_id, ts, user_id as subject, event_type as action from {events}""",
}

_DEPENDS = {name: tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", sql))) for name, sql in VIEWS.items()}


#: Session setting: partitions over which input tables are dealt. Unset, tables are read as they lie; a bench on
#: files of one row group sets it to its cores.
INPUT_PARTITIONS = "tidemark.input.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shared table."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bases = {b: table(spark, sf_dir, b) for b in _DEPENDS[name]}
    return spark.sql(VIEWS[name], **bases)


def with_views(sql: str) -> str:
    """The statement preceded by the views it names, for a plain SQL engine."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = []
    for n in used:
        body = VIEWS[n].format(**{b: b for b in _DEPENDS[n]})
        ctes.append(f"{n} as ({body})")
    head = ",\n".join(ctes)
    stripped = sql.lstrip()
    if stripped.lower().startswith("with recursive "):
        return f"with recursive {head},\n{stripped[len('with recursive '):]}"
    if stripped.lower().startswith("with "):
        return f"with {head},\n{stripped[5:]}"
    return f"with {head}\n{sql}"
