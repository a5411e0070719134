"""Upserts, appends, caches, reviews and refresh bookkeeping."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import state as st
from tidemark.operators.notices import next_dispatches
from tidemark.operators.ranking import top_k
from tidemark.session import new_state_dir
from tidemark.workload.registry import Inputs, query

NOW = datetime(2000, 6, 1)


@query("X15_append_snapshots", """
select snapshot_id, role_id, snapshot_at, rate from (
  select *, row_number() over (partition by role_id, snapshot_at order by snapshot_id) as rn from fx_snapshot) where rn = 1""")
def x15(t: Inputs):
    path = new_state_dir(t.spark, "snapshots")
    rows = t.fx_snapshot.withColumn("snapshot_at", F.col("snapshot_at").cast("timestamp"))
    early = rows.filter(F.col("snapshot_at") < "2024-01-20")
    st.append_snapshots(early, path)
    st.append_snapshots(rows, path)  # repeats the early rows, which must not be stored twice
    return t.spark.read.parquet(path).select("snapshot_id", "role_id", "snapshot_at", "rate")


@query("X16_upsert", """
with old as (select item_id, relevance, inference_summary_en as note, signal_weight from fx_evidence where relevance <> 'LOW'),
nw as (select item_id, 'NEW' as relevance, case when source_type = 'BLOG' then summary_en end as note, signal_weight / 2 as signal_weight
       from fx_evidence where impact <> 'INCREASE')
select coalesce(n.item_id, o.item_id) as item_id, coalesce(n.relevance, o.relevance) as relevance, coalesce(n.note, o.note) as note,
       case when n.item_id is not null then n.signal_weight else o.signal_weight end as signal_weight
from old o full outer join nw n on o.item_id = n.item_id""")
def x16(t: Inputs):
    e = t.fx_evidence
    old = e.filter(F.col("relevance") != "LOW").select(
        "item_id", "relevance", F.col("inference_summary_en").alias("note"), "signal_weight"
    )
    new = e.filter(F.col("impact") != "INCREASE").select(
        "item_id", F.lit("NEW").alias("relevance"),
        F.when(F.col("source_type") == "BLOG", F.col("summary_en")).alias("note"),
        (F.col("signal_weight") / 2).alias("signal_weight"),
    )
    return st.upsert(old, new, ["item_id"], keep_if_null=["note"])


@query("X17_replace_children", """
select l_orderkey as run_id, l_linenumber as rank, concat('old ', l_suppkey) as hit from lineitem
  where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')
union all
select o_orderkey, unnest([1, 2]), unnest(['first ', 'second ']) || o_orderpriority from orders where o_orderstatus = 'F'""")
def x17(t: Inputs):
    old = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("old "), "l_suppkey").alias("hit")
    )
    runs = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("run_id"), "o_orderpriority")
    hits = runs.select(
        "run_id",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("rank"), F.concat(F.lit(w), "o_orderpriority").alias("hit"))
            for i, w in ((1, "first "), (2, "second "))
        ])),
    )
    return st.replace_children(old, runs, hits, ["run_id"])


@query("I6_decision_upsert", """
with old as (select item_id, decision_status, review_status, case when review_status <> 'PENDING' then published_at end as reviewed_at
             from fx_evidence where relevance <> 'LOW'),
nw as (select item_id, 'ACCEPTED' as decision_status, case when source_type = 'BLOG' then 'APPROVED' when source_type = 'NEWS' then 'PENDING' end
         as review_status from fx_evidence where impact <> 'INCREASE'),
j as (select coalesce(n.item_id, o.item_id) as item_id, coalesce(n.decision_status, o.decision_status) as decision_status,
        coalesce(n.review_status, o.review_status, 'PENDING') as status, n.review_status as stated, n.item_id is null as untouched,
        o.reviewed_at as old_at from old o full outer join nw n on o.item_id = n.item_id)
select item_id, decision_status, status as review_status,
       case when untouched then old_at when status = 'PENDING' then null when stated is not null then timestamp '2000-06-01'
            else coalesce(old_at, timestamp '2000-06-01') end as reviewed_at from j""")
def i6(t: Inputs):
    e = t.fx_evidence
    reviewed = F.when(F.col("review_status") != "PENDING", F.col("published_at"))
    old = e.filter(F.col("relevance") != "LOW").select(
        "item_id", "decision_status", "review_status", reviewed.alias("reviewed_at")
    )
    stated = F.when(F.col("source_type") == "BLOG", "APPROVED").when(F.col("source_type") == "NEWS", "PENDING")
    new = e.filter(F.col("impact") != "INCREASE").select(
        "item_id", F.lit("ACCEPTED").alias("decision_status"), stated.alias("review_status")
    )
    return st.upsert_decisions(old, new, NOW)


@query("I14_review_actions", """
with d as (select item_id, decision_slug, decision_status, review_status from fx_evidence where relevance <> 'LOW'),
a as (select item_id, case when source_type = 'BLOG' then 'approve' else 'reject' end as action from fx_evidence where impact = 'DECREASE'),
j as (select a.item_id, a.action, d.item_id is not null as known, d.decision_slug, d.decision_status from a left join d on a.item_id = d.item_id),
p as (select *, case when not known then 'unknown decision' when action = 'approve' and not (decision_slug is not null and
        decision_status = 'ACCEPTED') then 'not reviewable yet' end as problem from j)
select d.item_id, case when p.item_id is null then d.review_status when p.action = 'approve' then 'APPROVED' else 'REJECTED' end as review_status,
       null as problem from d left join p on d.item_id = p.item_id and p.problem is null
union all select item_id, action, problem from p where problem is not null""")
def i14(t: Inputs):
    e = t.fx_evidence
    decisions = e.filter(F.col("relevance") != "LOW").select(
        "item_id", "decision_slug", "decision_status", "review_status", F.lit(None).cast("timestamp").alias("reviewed_at")
    )
    actions = e.filter(F.col("impact") == "DECREASE").select(
        "item_id", F.when(F.col("source_type") == "BLOG", "approve").otherwise("reject").alias("action")
    )
    after, refused = st.apply_reviews(decisions, actions, NOW)
    return after.select("item_id", "review_status", F.lit(None).cast("string").alias("problem")).unionByName(
        refused.select("item_id", F.col("action").alias("review_status"), "problem")
    )


@query("J9_fresh_runs", """
select o_orderkey as probe, case when o_orderdate + interval 24 hour > timestamp '2000-06-01' then o_orderkey end as run_id,
       o_orderdate + interval 24 hour > timestamp '2000-06-01' as fresh from orders""")
def j9(t: Inputs):
    day = F.expr("o_orderdate + interval 24 hour")
    text = F.concat_ws(" ", "o_orderpriority", "o_orderkey")
    runs = t.orders.select(F.md5(text).alias("query_hash"), F.col("o_orderkey").alias("run_id"), day.alias("expires_at"))
    probes = t.orders.select(F.md5(text).alias("query_hash"), F.col("o_orderkey").alias("probe"))
    return st.probe_runs(probes, runs, NOW).select("probe", "run_id", "fresh")


@query("W16_dispatch_fifo", """
select o_orderkey as dispatch_id from orders where o_orderstatus = 'P' order by o_orderdate, o_orderkey limit 20""")
def w16(t: Inputs):
    queue = t.orders.select(
        F.col("o_orderkey").alias("dispatch_id"), F.col("o_orderdate").alias("queued_at"),
        F.when(F.col("o_orderstatus") == "P", "PENDING").otherwise("SENT").alias("status"),
    )
    return next_dispatches(queue).select("dispatch_id")


@query("W19_hits_by_rank", """
with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem)
select l_orderkey as run_id, string_agg(concat(l_linenumber, ':', l_partkey), ',' order by rn) as hits from r where rn <= 20 group by l_orderkey""")
def w19(t: Inputs):
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    hits = top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], order, 20, rank="rn")
    entry = F.struct("rn", F.concat_ws(":", "l_linenumber", "l_partkey").alias("hit"))
    listed = hits.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.array_sort(F.collect_list(entry)).alias("h"))
    return listed.select("run_id", F.array_join(F.transform("h", lambda x: x["hit"]), ",").alias("hits"))


@query("A13_refresh_targets", """
select distinct slug from (
  select unnest([trim(concat(' r', o_custkey, ' ')), nullif(trim('  '), '')]) as slug from orders
  union all select coalesce(case when o_orderstatus = 'O' then concat('o', o_custkey) end, concat('f', o_custkey)) from orders
  union all select coalesce(nullif(trim(case when o_orderstatus = 'F' then ' ' else concat('x', o_custkey) end), ''), concat('y', o_custkey)) from orders)
where slug is not null""")
def a13(t: Inputs):
    c = F.col("o_custkey").cast("string")
    results = t.orders.select(
        F.array(F.concat(F.lit(" r"), c, F.lit(" ")), F.lit("  ")).alias("affected_slugs"),
        F.array(F.struct(F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("o"), c)).alias("role_slug"),
                         F.concat(F.lit("f"), c).alias("slug"))).alias("affected_roles"),
        F.array(F.struct(F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.concat(F.lit("x"), c)).alias("role_slug"),
                         F.concat(F.lit("y"), c).alias("assigned_slug"))).alias("signals"),
    )
    return st.refresh_targets(results)


# state after a refresh: rates move for some roles, some caches are renewed, some refreshes fail
AFTER = """
    select slug, replacement_rate + 1 as replacement_rate, risk_level, rating_status,
           case when s_rules = 0 then last_rated_at else cast('2024-06-01' as timestamp) end as last_rated_at,
           case when s_workflow = 0 then risk_cached_at when s_workflow = 1 then null
                else cast('2024-06-01' as timestamp) end as risk_cached_at from {st}"""
OUTCOME = """
    select slug, s_repetition % 3 as targets, s_physical = 4 and s_repetition % 3 > 0 as own_failed,
           s_physical >= 3 as failed, s_transformation as timeline_hits, s_repetition % 3 as refreshed from {st}"""


@query("I10_refresh_snapshots", f"""
with a as ({AFTER.format(st='fx_state')}), o as ({OUTCOME.format(st='fx_state')})
select o.slug, case when targets = 0 then b.replacement_rate else coalesce(a.replacement_rate, b.replacement_rate) end as replacement_rate,
       b.risk_level, b.rating_status,
       targets > 0 and (coalesce(a.last_rated_at, b.last_rated_at) is distinct from b.last_rated_at
         or coalesce(a.risk_cached_at, b.risk_cached_at) is distinct from b.risk_cached_at) as was_recomputed
from o join fx_state b on o.slug = b.slug join a on o.slug = a.slug where not own_failed""")
def i10(t: Inputs):
    before = t.fx_state
    after = t.spark.sql(AFTER, st=before)
    outcome = t.spark.sql(OUTCOME, st=before)
    return st.refresh_snapshots(before, after, outcome, datetime(2024, 6, 1)).select(
        "slug", "replacement_rate", "risk_level", "rating_status", "was_recomputed"
    )


@query("A5_refresh_totals", f"""
select count(*) as total_roles, count(*) filter (not failed) as successes, count(*) filter (failed) as failures,
       count(*) filter (timeline_hits > 0) as roles_with_hits, cast(sum(refreshed) as bigint) as refreshed
from ({OUTCOME.format(st='fx_state')})""")
def a5(t: Inputs):
    return st.refresh_totals(t.spark.sql(OUTCOME, st=t.fx_state))
