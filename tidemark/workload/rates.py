"""Rates, bands, trends and the structural score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rates
from tidemark.operators.trend import structural_scores, trend
from tidemark.workload.registry import Inputs, query

BAND_SQL = "case when {r} >= 80 then 'SEVERE' when {r} >= 55 then 'HIGH' when {r} >= 30 then 'MEDIUM' else 'LOW' end"


@query("P15_clamp_rate", """
select event_id, cast(least(95, greatest(5, floor(value * 3 - 20 + 0.5))) as int) as rate from events""")
def p15(t: Inputs):
    return t.events.select("event_id", rates.clamp_rate(F.col("value") * 3 - 20).alias("rate"))


@query("P16_band", f"""
select event_id, {BAND_SQL.format(r='(value * 3)')} as level from events""")
def p16(t: Inputs):
    return t.events.select("event_id", rates.band(F.col("value") * 3).alias("level"))


@query("P22_delta", """
with s as (select *, lag(rate) over (partition by role_id order by snapshot_at, snapshot_id) as prev from fx_snapshot)
select snapshot_id, rate - prev as delta, abs(rate - prev) as absolute_delta,
       case when rate > prev then 'up' when rate < prev then 'down' when rate = prev then 'flat' end as direction
from s""")
def p22(t: Inputs):
    from pyspark.sql import Window

    w = Window.partitionBy("role_id").orderBy("snapshot_at", "snapshot_id")
    s = t.fx_snapshot.withColumn("prev", F.lag("rate").over(w))
    prev, rate = F.col("prev"), F.col("rate")
    return s.select(
        "snapshot_id", rates.delta(prev, rate).alias("delta"),
        F.abs(rates.delta(prev, rate)).alias("absolute_delta"), rates.direction(prev, rate).alias("direction"),
    )


TREND_SQL = """
with s as (select role_id, rate, snapshot_at + interval 8 hour as lt from fx_snapshot where rate is not null),
b as (select role_id, rate, 'week' as grain, strftime(date_trunc('week', lt), '%Y-%m-%d') as bucket from s
      union all select role_id, rate, 'month', strftime(lt, '%Y-%m') from s)
select role_id, grain, bucket, cast(floor(avg(rate) + 0.5) as bigint) as average_rate, count(*) as points
from b group by role_id, grain, bucket"""


@query("A2_trend_buckets", TREND_SQL)
def a2(t: Inputs):
    return trend(t.fx_snapshot)


@query("P30_structural_score", """
with g as (select role_slug as slug, sum(case relevance when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end) as boost,
                  count(*) as n from fx_evidence where impact = 'DECREASE' and source_type = 'BLOG' group by role_slug),
j as (select s.slug, s_repetition + s_rules + s_transformation + s_workflow - s_interpersonal - s_physical
             - s_ambiguity as base, coalesce(boost, 0) as boost, coalesce(n, 0) as n
      from fx_state s left join g on s.slug = g.slug)
select slug,
  case when base + boost < 2 and n = 0 then 'INSUFFICIENT_SIGNAL' else 'RATED' end as status,
  case when base + boost < 2 and n = 0 then 'LOW' when base + boost >= 14 then 'SEVERE'
       when base + boost >= 7 then 'HIGH' when base + boost >= 4 then 'MEDIUM' else 'LOW' end as level,
  case when base + boost < 2 and n = 0 then 'STABLE' when base + boost >= 14 then 'RISING'
       when base + boost >= 4 and boost > 0 then 'RISING' else 'STABLE' end as trend
from j""")
def p30(t: Inputs):
    signals = t.fx_evidence.filter((F.col("impact") == "DECREASE") & (F.col("source_type") == "BLOG")).select(
        F.col("role_slug").alias("slug"), F.col("relevance").alias("strength")
    )
    return structural_scores(t.fx_state, signals)


@query("P36_normalised_score", f"""
with r as (select event_id, cast(least(95, greatest(5, floor(value * 2 + 0.5))) as int) as rate, event_type, user_id from events)
select event_id, rate, {BAND_SQL.format(r='rate')} as level,
       case when user_id % 2 = 0 then concat('zh ', event_type) else event_type end as summary_zh,
       concat('T:', case when user_id % 3 = 0 then concat('zt ', event_type) else event_type end, '|D:',
              case when user_id % 4 = 0 then concat('zd ', event_type) else concat('d ', event_type) end) as reason_zh
from r""")
def p36(t: Inputs):
    e = t.events
    user = F.col("user_id")
    kind = F.col("event_type")
    reason = F.struct(
        F.lit("media").alias("kind"),
        kind.alias("title_en"),
        F.when(user % 3 == 0, F.concat(F.lit("zt "), kind)).alias("title_zh"),
        F.concat(F.lit("d "), kind).alias("detail_en"),
        F.when(user % 4 == 0, F.concat(F.lit("zd "), kind)).alias("detail_zh"),
    )
    zh = F.when(user % 2 == 0, F.concat(F.lit("zh "), kind))
    rate = rates.clamp_rate(F.col("value") * 2)
    out = e.select(
        "event_id", rate.alias("rate"), rates.band(rate).alias("level"),
        F.coalesce(zh, kind).alias("summary_zh"), rates.normalised_reasons(F.array(reason)).alias("reasons"),
    )
    r = F.col("reasons")[0]
    return out.select(
        "event_id", "rate", "level", "summary_zh",
        F.concat(F.lit("T:"), r["title_zh"], F.lit("|D:"), r["detail_zh"]).alias("reason_zh"),
    )


@query("P38_bar_share", """
with m as (select max(replacement_rate) as m from fx_state)
select slug, greatest(8.0, replacement_rate::double / greatest(m::double, 1.0) * 100) as share
from fx_state, m where replacement_rate is not null""")
def p38(t: Inputs):
    rated = t.fx_state.filter(F.col("replacement_rate").isNotNull()).select("slug", "replacement_rate")
    largest = rated.agg(F.max("replacement_rate")).scalar()
    return rated.select("slug", rates.bar_share(F.col("replacement_rate"), largest).alias("share"))
