"""Streams drained over the shared tables, and the batch forms of the limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.urls import canonical
from tidemark.session import new_state_dir
from tidemark.streaming import limits
from tidemark.streaming import tables as st
from tidemark.views import VIEWS
from tidemark.workload.rates import TREND_SQL
from tidemark.workload.registry import Inputs, query
from tidemark.workload.urls import KEYED

DAY = 86400
# the log is sparse, so the periods are days rather than minutes
THROTTLE = dict(window_s=3 * DAY, maximum=4, block_s=1 * DAY)
CODES = dict(cooldown_s=DAY // 4, window_s=4 * DAY, maximum=3, ttl_s=2 * DAY, failures=2, lock_s=2 * DAY)

THROTTLE_SQL = f"""with recursive e as (select event_id, subject, epoch_us(ts) as us, row_number() over (partition by subject order by ts, event_id) as rn
   from fx_auth_event),
m as (
  select subject, rn, event_id, us as started, 1 as cnt, cast(null as bigint) as blocked, 'allowed' as verdict from e where rn = 1
  union all
  select e.subject, e.rn, e.event_id,
    case when m.blocked > e.us then m.started when e.us - m.started >= {THROTTLE['window_s']}000000 then e.us else m.started end,
    case when m.blocked > e.us then m.cnt when e.us - m.started >= {THROTTLE['window_s']}000000 then 1 else m.cnt + 1 end,
    case when m.blocked > e.us then m.blocked when e.us - m.started >= {THROTTLE['window_s']}000000 then null
         when m.cnt >= {THROTTLE['maximum']} then e.us + {THROTTLE['block_s']}000000 end,
    case when m.blocked > e.us then 'blocked' when e.us - m.started >= {THROTTLE['window_s']}000000 then 'allowed'
         when m.cnt >= {THROTTLE['maximum']} then 'blocked' else 'allowed' end
  from m join e on e.subject = m.subject and e.rn = m.rn + 1)
select event_id, verdict from m"""


@query("S1_throttle_replay", THROTTLE_SQL)
def s1(t: Inputs):
    return limits.replay(t.fx_auth_event, limits.throttle(**THROTTLE))


def drained(t: Inputs, stream, name: str):
    path = new_state_dir(t.spark, name)
    st.drain(stream, st.append_to(path))
    return t.spark.read.parquet(path).drop("batch")


def stream_of(t: Inputs, table: str):
    return st.read_stream(t.spark, f"{t.sf_dir.rstrip('/')}/{table}.parquet")


def auth_stream(t: Inputs):
    return stream_of(t, "events").select("event_id", "ts", F.col("user_id").alias("subject"), F.col("event_type").alias("action"))


@query("S1_throttle_stream", THROTTLE_SQL)
def s1_stream(t: Inputs):
    return drained(t, limits.enforce(auth_stream(t), limits.throttle(**THROTTLE)), "throttle")


def _codes_sql() -> str:
    c = {k: f"{v}000000" if k.endswith("_s") else v for k, v in CODES.items()}
    lk = "coalesce(m.locked > e.us, false)"
    cool = f"coalesce(e.us - m.last < {c['cooldown_s']}, false)"
    fresh = f"(m.started is null or e.us - m.started >= {c['window_s']})"
    limit = f"(not {fresh} and m.cnt >= {c['maximum']})"
    issued = f"(e.action = 'request' and not {lk} and not {cool} and not {limit})"
    live = "coalesce(m.expires > e.us, false)"
    verified = f"(e.action = 'verify' and {live} and not {lk})"
    failed = f"(e.action = 'fail' and {live} and not {lk})"
    return f"""with recursive e as (select event_id, subject, case when action in ('click', 'view') then 'request' when action = 'error' then 'fail'
      else 'verify' end as action, epoch_us(ts) as us, row_number() over (partition by subject order by ts, event_id) as rn from fx_auth_event),
m as (
  select distinct subject, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(null as bigint) as started, 0 as cnt, cast(null as bigint) as last,
     0 as fails, cast(null as bigint) as locked, cast(null as bigint) as expires, 'none' as verdict from e
  union all
  select e.subject, e.rn, e.event_id,
    case when {issued} and {fresh} then e.us else m.started end,
    case when {issued} then case when {fresh} then 1 else m.cnt + 1 end else m.cnt end,
    case when {issued} then e.us else m.last end,
    case when {issued} then 0 when {failed} then m.fails + 1 else m.fails end,
    case when {issued} then null when {failed} then case when m.fails + 1 >= {c['failures']} then e.us + {c['lock_s']} end else m.locked end,
    case when {issued} then e.us + {c['ttl_s']} when {verified} then null else m.expires end,
    case when e.action = 'request' then case when {lk} then 'locked' when {cool} then 'cooldown' when {limit} then 'limit' else 'issued' end
         when not {live} then 'invalid' when {lk} then 'locked' when e.action = 'verify' then 'verified'
         when m.fails + 1 >= {c['failures']} then 'locked' else 'invalid' end
  from m join e on e.subject = m.subject and e.rn = m.rn + 1)
select event_id, verdict from m where rn > 0"""


def code_events(events):
    return events.withColumn("action", limits.action_of(F.col("action"), ("click", "view"), ("error",)))


@query("S2_sign_in_replay", _codes_sql())
def s2(t: Inputs):
    return limits.replay(code_events(t.fx_auth_event), limits.sign_in_codes(**CODES))


@query("S2_sign_in_stream", _codes_sql())
def s2_stream(t: Inputs):
    return drained(t, limits.enforce(code_events(auth_stream(t)), limits.sign_in_codes(**CODES)), "codes")


@query("S3_first_seen_stream", f"""
with {KEYED}, r as (select *, row_number() over (partition by key order by source_ord, idx) as rn from keyed)
select key, source_ord, idx from r where rn = 1""")
def s3(t: Inputs):
    fetched = t.spark.sql(VIEWS["fx_fetch"], pages=stream_of(t, "pages"))
    keyed = fetched.select(canonical(F.col("source_url")).alias("key"), "source_ord", "idx")
    path = new_state_dir(t.spark, "seen")
    st.drain(st.first_seen(keyed, ["key"], ["source_ord", "idx"]), st.append_to(path), mode="update")
    return st.seen_rows(t.spark, path)


@query("S4_upsert_stream", """
with old as (select item_id, relevance, inference_summary_en as note from fx_evidence where relevance <> 'LOW'),
nw as (select item_id, 'NEW' as relevance, case when source_type = 'BLOG' then summary_en end as note from fx_evidence where impact <> 'INCREASE')
select coalesce(n.item_id, o.item_id) as item_id, coalesce(n.relevance, o.relevance) as relevance, coalesce(n.note, o.note) as note
from old o full outer join nw n on o.item_id = n.item_id""")
def s4(t: Inputs):
    initial = t.fx_evidence.filter(F.col("relevance") != "LOW").select(
        "item_id", "relevance", F.col("inference_summary_en").alias("note")
    )
    changes = t.spark.sql(VIEWS["fx_evidence"], lineitem=stream_of(t, "lineitem")).filter(
        F.col("impact") != "INCREASE"
    ).select("item_id", F.lit("NEW").alias("relevance"),
             F.when(F.col("source_type") == "BLOG", F.col("summary_en")).alias("note"))
    path = new_state_dir(t.spark, "upserts")
    st.drain(changes, st.upsert_into(path, initial, ["item_id"], [F.col("note")], keep_if_null=["note"]))
    return st.latest_version(t.spark, path)


@query("S5_trend_stream", TREND_SQL)
def s5(t: Inputs):
    snapshots = t.spark.sql(VIEWS["fx_snapshot"], events=stream_of(t, "events"))
    totals = st.trend_stream(snapshots)
    path = new_state_dir(t.spark, "trend")
    st.drain(totals, st.upsert_into(path, None, ["role_id", "grain", "bucket"], []), mode="update")
    return st.trend_rates(st.latest_version(t.spark, path))
