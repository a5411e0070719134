"""Subscriptions and notifications."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import notices as nt
from tidemark.operators import timeline as tl
from tidemark.workload.registry import Inputs, query
from tidemark.workload.timelines import MEMBER

NOW = datetime(2024, 6, 1)
BASIS = """basis as (select lower(trim(email)) as email, max(last_digest_at) as last_digest_at, min(created_at) as oldest_created_at,
    count(*) as role_count from fx_sub group by 1)"""
PEND = "pend as (select * from fx_pending where status = 'PENDING')"


@query("A7_digest_basis", f"with {BASIS} select * from basis")
def a7(t: Inputs):
    return nt.digest_basis(t.fx_sub)


@query("A8_tracked_emails", "select distinct lower(trim(email)) as email from fx_sub")
def a8(t: Inputs):
    return nt.tracked_emails(t.fx_sub)


@query("A9_watch_limit", """
with have as (select distinct lower(trim(email)) as email, slug from fx_sub where created_at < '1996-01-01'),
asked as (select lower(trim(email)) as email, slug, min(created_at) as requested_at from fx_sub group by 1, 2),
known as (select a.* from asked a join have h using (email, slug)),
fresh as (select a.* from asked a where not exists (select 1 from have h where h.email = a.email and h.slug = a.slug)),
cnt as (select email, count(*) as n from have group by email),
rk as (select f.*, coalesce(n, 0) as n, row_number() over (partition by f.email order by requested_at, slug) as rn from fresh f left join cnt using (email))
select email, slug, 'known' as outcome from known
union all select email, slug, case when rn + n <= 3 then 'admitted' else 'refused' end from rk""")
def a9(t: Inputs):
    existing = t.fx_sub.filter(F.col("created_at") < "1996-01-01")
    requests = t.fx_sub.withColumn("requested_at", F.col("created_at"))
    return nt.admit_subscriptions(existing, requests).select("email", "slug", "outcome")


@query("P24_digest_due", f"""
with {BASIS} select email, epoch_us(timestamp '2024-06-01') - epoch_us(coalesce(last_digest_at, oldest_created_at)) >= 604800000000 as due from basis""")
def p24(t: Inputs):
    b = nt.digest_basis(t.fx_sub)
    return b.select("email", nt.digest_due(F.col("last_digest_at"), F.col("oldest_created_at"), NOW).alias("due"))


MOVED = """moved as (select lower(trim(s.email)) as email, s.slug, s.created_at, s.last_alert_at, s.last_alert_rate, r.replacement_rate, r.name_en,
    coalesce(abs(r.replacement_rate - s.last_alert_rate) >= 8 and r.last_rated_at > coalesce(s.last_alert_at, s.created_at), false) as significant
  from fx_sub s join fx_state r on s.slug = r.slug)"""


@query("P23_significant_change", f"with {MOVED} select email, slug, significant from moved")
def p23(t: Inputs):
    j = t.fx_sub.join(t.fx_state.select("slug", "replacement_rate", "last_rated_at"), "slug")
    flag = nt.significant_change(
        F.col("last_alert_rate"), F.col("replacement_rate"), F.col("last_rated_at"), F.col("created_at"), F.col("last_alert_at")
    )
    return j.select(F.lower(F.trim("email")).alias("email"), "slug", flag.alias("significant"))


@query("J10_pending_exclusion", f"""
with {PEND},
c as (select lower(trim(email)) as email, 'SIGNIFICANT_CHANGE' as kind, slug from fx_sub
      union all select distinct lower(trim(email)), 'WEEKLY_DIGEST', null from fx_sub)
select c.* from c where not exists (select 1 from pend p where p.email = c.email and p.kind = c.kind and p.slug is not distinct from c.slug)""")
def j10(t: Inputs):
    email = F.lower(F.trim("email")).alias("email")
    alerts = t.fx_sub.select(email, F.lit("SIGNIFICANT_CHANGE").alias("kind"), "slug")
    digests = t.fx_sub.select(email).distinct().select(
        "email", F.lit("WEEKLY_DIGEST").alias("kind"), F.lit(None).cast("string").alias("slug")
    )
    return nt.without_pending(alerts.unionByName(digests), t.fx_pending)


DUE = f"""{BASIS}, {PEND}, {MOVED}, {MEMBER},
line as (select *, row_number() over (partition by slug order by published_at desc, item_id) as timeline_rank from mem
         where not (lower(source_url) like '%example.com%')),
pub as (select * from line where regexp_replace(lower(regexp_extract(source_url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') <> 'example.com'),
dg as (select b.*, coalesce(last_digest_at, oldest_created_at) as boundary from basis b
       where epoch_us(timestamp '2024-06-01') - epoch_us(coalesce(last_digest_at, oldest_created_at)) >= 604800000000
         and not exists (select 1 from pend p where p.email = b.email and p.kind = 'WEEKLY_DIGEST' and p.slug is null)),
dr as (select d.email, d.boundary, s.slug, s.created_at, (select count(*) from pub l where l.slug = s.slug and l.timeline_rank <= 2
         and l.published_at > d.boundary) as items
       from dg d join fx_sub s on lower(trim(s.email)) = d.email join fx_state r on r.slug = s.slug),
al as (select m.*, coalesce(last_alert_at, created_at) as boundary from moved m where significant
        and not exists (select 1 from pend p where p.email = m.email and p.kind = 'SIGNIFICANT_CHANGE' and p.slug = m.slug))"""


@query("I12_due_notifications", f"""
with {DUE}
select email, null as slug, 'WEEKLY_DIGEST' as kind, boundary,
   concat('Demo weekly digest for ', count(*), ' tracked role', case when count(*) = 1 then '' else 's' end) as subject from dr group by email, boundary
union all
select email, slug, 'SIGNIFICANT_CHANGE', boundary, concat('Demo alert: ', name_en, ' moved to ', replacement_rate, '%') from al""")
def i12(t: Inputs):
    line = tl.timelines(t.fx_evidence, 3)
    due = nt.due_notifications(t.fx_sub, t.fx_state, line, t.fx_pending, NOW, "Demo")
    return due.select("email", "slug", "kind", "boundary", "subject")


@query("X19_digest_payload", f"""
with {DUE}
select email, count(*) as roles, cast(sum(items) as bigint) as items, string_agg(slug, ',' order by created_at, slug) as slugs from dr group by email""")
def x19(t: Inputs):
    line = tl.timelines(t.fx_evidence, 3)
    due = nt.due_digests(t.fx_sub, t.fx_state, line, t.fx_pending, NOW, "Demo")
    shape = "roles array<struct<slug string, recent_items array<struct<title string>>>>"
    roles = F.from_json("payload", shape)["roles"]
    parsed = due.select("email", roles.alias("r"))
    count = F.aggregate("r", F.lit(0), lambda acc, x: acc + F.size(x["recent_items"]))
    return parsed.select(
        "email", F.size("r").cast("long").alias("roles"), count.cast("long").alias("items"),
        F.array_join(F.transform("r", lambda x: x["slug"]), ",").alias("slugs"),
    )


@query("I13_dispatch_outcomes", """
with q as (select dispatch_id, email, kind, slug, status from fx_pending),
o as (select dispatch_id, case when slug is null or dispatch_id % 4 = 1 then 'SENT' else 'FAILED' end as outcome,
        cast('2024-06-02' as timestamp) + to_hours(cast(dispatch_id % 5 as int)) as sent_at, concat('smtp ', dispatch_id) as error
      from q where status = 'PENDING'),
s as (select q.*, o.sent_at, cast(q.dispatch_id % 50 as int) as rate from q join o using (dispatch_id) where outcome = 'SENT'),
dg as (select email, max(sent_at) as at from s where kind = 'WEEKLY_DIGEST' group by email),
al as (select email, slug, max(sent_at) as at, max_by(rate, sent_at) as rate from s where kind = 'SIGNIFICANT_CHANGE' group by email, slug)
select 'queue' as part, cast(dispatch_id as varchar) as id, coalesce(outcome, status) as status, case when outcome = 'SENT' then sent_at end as at,
       case when outcome = 'FAILED' then error end as note from q left join o using (dispatch_id)
union all
select 'sub', concat(lower(trim(u.email)), '/', u.slug), cast(case when al.at is not null then al.rate else u.last_alert_rate end as varchar),
       coalesce(dg.at, u.last_digest_at), cast(coalesce(al.at, u.last_alert_at) as varchar)
from fx_sub u left join dg on dg.email = lower(trim(u.email)) left join al on al.email = lower(trim(u.email)) and al.slug = u.slug""")
def i13(t: Inputs):
    queue = t.fx_pending.withColumns(
        {"sent_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")}
    )
    waiting = queue.filter(F.col("status") == "PENDING")
    hours = F.make_interval(hours=(F.col("dispatch_id") % 5).cast("int"))
    outcomes = waiting.select(
        "dispatch_id",
        F.when(F.col("slug").isNull() | (F.col("dispatch_id") % 4 == 1), "SENT").otherwise("FAILED").alias("outcome"),
        (F.lit(datetime(2024, 6, 2)) + hours).alias("sent_at"), F.concat(F.lit("smtp "), "dispatch_id").alias("error"),
    )
    after = nt.apply_outcomes(queue, outcomes)
    sent = after.filter((F.col("status") == "SENT") & F.col("sent_at").isNotNull()).withColumn(
        "rate", (F.col("dispatch_id") % 50).cast("int")
    )
    subs = nt.stamp_subscriptions(t.fx_sub, sent)
    return after.select(
        F.lit("queue").alias("part"), F.col("dispatch_id").cast("string").alias("id"), "status", F.col("sent_at").alias("at"),
        F.col("error").alias("note"),
    ).unionByName(
        subs.select(
            F.lit("sub").alias("part"), F.concat_ws("/", "email", "slug").alias("id"),
            F.col("last_alert_rate").cast("string").alias("status"), F.col("last_digest_at").alias("at"),
            F.date_format("last_alert_at", "yyyy-MM-dd HH:mm:ss").alias("note"),
        )
    )
