"""Queries over time on events, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import longitudinal as lo
from tidemark.plans.registry import query


def monthly(t):
    month = F.date_format("o_orderdate", "yyyy-MM")
    g = t.orders.groupBy("o_custkey", month.alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.max(F.to_date("o_orderdate")).alias("observation_date"))
    return g.select("o_custkey", "period", "value", "observation_date", F.lit(None).cast("date").alias("publication_date"), F.lit("USD").alias("currency"), F.lit("unit").alias("unit"))


@query("""with g as (select o_custkey, strftime(o_orderdate, '%Y-%m') as period, round(sum(o_totalprice), 2) as value, max(o_orderdate::date) as d from orders group by 1, 2),
w as (select *, lag(period) over p as prior_period, lag(value) over p as prior_value, row_number() over (partition by o_custkey order by d desc, period desc) as r from g window p as (partition by o_custkey order by d, period))
select o_custkey, prior_period, period, prior_value, value, round((value - prior_value) / abs(prior_value), 9) as pct_change from w where r = 1 and prior_value <> 0""")
def period_change(t):
    return lo.period_change(monthly(t), ["o_custkey"]).withColumn("pct_change", F.round("pct_change", 9))


@query("""with c as (select user_id, event_type, strftime(ts, '%G-%V') as period, count(*) as n from events group by all),
w as (select *, lag(n) over (partition by user_id, event_type order by period) as prior, count(*) over (partition by user_id, event_type) as persistence, max(period) over (partition by user_id, event_type) as last from c)
select user_id, event_type, period, n, n - coalesce(prior, 0) as change, persistence = 1 as new_flag, persistence from w where period = last""")
def event_period_features(t):
    iso = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return lo.event_period_features(t.events.withColumn("week", iso), ["user_id", "event_type"], "week")


@query("select event_id, case when row_number() over (partition by user_id, event_type order by strftime(ts, '%G-%V'), event_id) = 1 then 'new' else 'persistent' end as novelty from events")
def novelty(t):
    iso = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return lo.novelty(t.events.withColumn("week", iso), ["user_id", "event_type"], ["week", "event_id"]).select("event_id", "novelty")


DAILY = "d as (select event_type, ts::date as ts, count(*) as open_count from events group by all)"


def daily(t, by="event_type"):
    return t.events.groupBy(by, F.to_date("ts").alias("ts")).agg(F.count(F.lit(1)).alias("open_count"))


@query(f"""with {DAILY}, w as (select *, lag(open_count) over p as p, lag(ts) over p as t from d window p as (partition by event_type order by ts))
select event_type, ts, open_count, open_count - p as delta, round((open_count - p) / greatest(p, 1)::double, 9) as acceleration, round((open_count - p) / greatest(date_diff('day', t, ts), 1)::double, 9) as velocity from w where p is not null""")
def velocity(t):
    return lo.snapshot_velocity(daily(t), ["event_type"]).withColumns({c: F.round(c, 9) for c in ("acceleration", "velocity")})


@query("""with p as (select page_id, regexp_extract(url, '://([^/?#]+)', 1) as host, md5(html) as h from pages)
select page_id, host, coalesce(lag(h) over w is distinct from h, true) or row_number() over w = 1 as changed from p window w as (partition by host order by page_id)""")
def page_change(t):
    p = t.pages.select("page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"), F.md5("html").alias("h"))
    return lo.page_changes(p, ["host"], "page_id", "h").select("page_id", "host", "changed")


@query(f"""with {DAILY}, g as (select event_type, list(ts order by ts) as t from d group by 1), x as (select event_type, len(t) as snapshots, list_transform(range(1, len(t)), lambda i: date_diff('day', t[i], t[i + 1])) as gaps from g),
y as (select *, list_avg(gaps) as mean from x)
select event_type, snapshots::integer as snapshots, array_to_string(gaps, ',') as gaps, round(mean, 9) as mean, case when len(gaps) < 2 then 'NOT_ASSESSED' when mean > 0 and list_max(list_transform(gaps, lambda v: abs(v - mean))) / mean <= 0.25 then 'CONSISTENT' else 'IRREGULAR' end as consistent, case when snapshots = 1 then 'SINGLE' when snapshots >= 4 then 'SUFFICIENT_FOR_POLICY' else 'SHALLOW' end as depth from y""")
def history_context(t):
    out = lo.history_context(daily(t), ["event_type"], "ts")
    return out.withColumn("gaps", F.array_join(F.col("gaps").cast("array<string>"), ",")).withColumn("mean", F.round("mean", 9))


@query("""with d as (select user_id, strftime(ts, '%G-%V') as w, count(*) as n from events group by all), g as (select user_id, list(n order by w) as v from d group by 1),
x as (select user_id, len(v) as snapshots, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) as c from g), y as (select *, list_filter(c, lambda q: q <> 0) as m from x),
z as (select *, len(list_filter(c, lambda q: q > 0)) > 0 and len(list_filter(c, lambda q: q < 0)) > 0 as both_ways from y)
select user_id, snapshots::integer as snapshots, case when snapshots < 2 then 'NOT_ASSESSED' when len(m) = 0 then 'STABLE' when both_ways then 'REVERSED' when len(m) = 1 then 'ONE_OFF'
  when len(list_filter(range(1, len(m)), lambda i: abs(m[i + 1]) <= abs(m[i]))) = 0 then 'ACCELERATING' else 'PERSISTENT' end as persistence, both_ways as contradiction from z""")
def persistence_status(t):
    iso = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    d = t.events.groupBy("user_id", iso.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return lo.persistence_status(d, ["user_id"], "w", "n").select("user_id", "snapshots", "persistence", "contradiction")


@query("""with d as (select user_id, ts::date as ts, count(*) as open_count from events group by all), r as (select *, row_number() over (partition by user_id order by ts desc) as r from d),
g as (select user_id, max(case when r = 1 then ts end) as latest, max(case when r = 1 then open_count end) as open_count, max(case when r = 2 then open_count end) as prior from r where r <= 2 group by 1)
select user_id, latest, open_count, open_count - prior as delta, coalesce(prior >= 10 and open_count <= 0.2 * prior, false) as anomaly, date '2024-01-31' > latest + 1 as stale from g""")
def source_health(t):
    d = daily(t, "user_id").withColumn("next_due", F.date_add("ts", 1))
    return lo.source_health(d, ["user_id"], F.lit("2024-01-31").cast("date"))


@query("select o_custkey, o_orderkey, (sum(c) over (partition by o_custkey order by o_orderdate, o_orderkey))::bigint as version from (select *, case when row_number() over w > 1 and lag(o_orderstatus) over w is not distinct from o_orderstatus then 0 else 1 end as c from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))")
def release_versioning(t):
    return lo.release_versions(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "version")


@query("""with c as (select user_id as company, ts::date as ts, count(*) filter (event_type = 'signup') as new_jobs, count(*) filter (event_type = 'error') as closed_jobs from events where event_type <> 'purchase' group by all),
f as (select user_id as company, ts::date as ts, 'observation' as kind, 1::bigint as n from events where event_type = 'purchase'
  union all select company, ts, 'new_jobs', new_jobs from c where new_jobs <> 0 union all select company, ts, 'closed_jobs', closed_jobs from c where closed_jobs <> 0)
select company, ts, kind, n from f where ts > (select max(ts) from f) - interval 7 day""")
def change_feed(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    o = e.where("event_type = 'purchase'").select(F.col("user_id").alias("company"), F.col("day").alias("ts"))
    c = e.where("event_type <> 'purchase'").groupBy(F.col("user_id").alias("company"), F.col("day").alias("ts")).agg(F.count(F.when(F.col("event_type") == "signup", 1)).alias("new_jobs"), F.count(F.when(F.col("event_type") == "error", 1)).alias("closed_jobs"))
    return lo.feed_period(lo.change_feed(o, c, ["new_jobs", "closed_jobs"]), 7)


@query("""with h as (select user_id, event_type, ts::date > date '2024-01-15' as half from events)
select half, 'event_type' as dimension, coalesce(event_type, 'unknown') as value, count(*) as n from h group by all union all select half, 'user', user_id::varchar, count(*) from h group by all""")
def snapshot_mix(t):
    h = t.events.select((F.to_date("ts") > F.lit("2024-01-15").cast("date")).alias("half"), "event_type", "user_id")
    return lo.snapshot_mix(h, ["half"], {"event_type": "event_type", "user": "user_id"})


@query("""with h as (select user_id, event_type, ts::date > date '2024-01-15' as half from events),
c as (select user_id, event_type, count(*) filter (half) as n, count(*) filter (not half) as prior from h group by all)
select user_id, event_type, n, n - prior as change, round(n / nullif(sum(n) over (partition by user_id), 0)::double, 9) as share from c""")
def job_mix_change(t):
    h = t.events.withColumn("half", F.to_date("ts") > F.lit("2024-01-15").cast("date"))
    return lo.mix_change(h.where("half"), h.where("not half"), ["user_id"], "event_type").withColumn("share", F.round("share", 9))


@query("""with h as (select user_id, event_type || '-' || extract(hour from ts)::varchar as job, ts::date > date '2024-01-15' as half from events), c as (select user_id, job, bool_or(half) as a, bool_or(not half) as b from h group by all)
select user_id, count(*) filter (not b) as new, count(*) filter (not a) as closed from c group by 1""")
def new_and_closed(t):
    h = t.events.select("user_id", F.concat_ws("-", "event_type", F.hour("ts").cast("string")).alias("job"), (F.to_date("ts") > F.lit("2024-01-15").cast("date")).alias("half"))
    return lo.new_and_closed(h.where("half"), h.where("not half"), ["user_id"], "job")


@query("select doc_id, source, lang from (select *, row_number() over (partition by lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) order by doc_id) as r from documents) where r = 1")
def dedupe_first(t):
    key = F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\f\\r]+", " "))), 256)
    return lo.dedupe_first(t.documents, [key], ["doc_id"]).select("doc_id", "source", "lang")


@query("select user_id, event_type, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as value, min(ts) as first_seen, max(ts) as last_seen from events group by all")
def dedupe_merge(t):
    e = t.events.withColumn("first_seen", F.col("ts")).withColumn("last_seen", F.col("ts"))
    return lo.dedupe_merge(e, ["user_id", "event_type"], "ts", ["event_id", "value"])


@query("select o_custkey, strftime(o_orderdate, '%Y-%m') as month, count(*) as n, array_to_string(list(o_orderkey order by o_orderkey), ',') as ids from orders group by all")
def activity_by_month(t):
    return lo.activity_by_month(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""with l as (select user_id, event_type as family, event_id % 7 <> 0 as has from events)
select user_id, array_to_string(list_sort(list(distinct family)), ',') as present, count(*) as evidence, bool_and(has) as provenance_complete, array_to_string(list_filter(['click', 'error', 'legal', 'purchase', 'signup', 'view'], lambda f: not list_contains(list(distinct family), f)), ',') as missing from l group by 1""")
def source_coverage(t):
    e = t.events.select("user_id", F.col("event_type").alias("family"), F.when(F.col("event_id") % 7 != 0, F.lit("h")).alias("source_hash"))
    out = lo.source_coverage(e, ["user_id"], ["click", "error", "legal", "purchase", "signup", "view"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("present", "missing")})
