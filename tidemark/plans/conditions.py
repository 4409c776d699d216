"""Condition queries on daily and weekly counts of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import conditions as co
from tidemark.plans.registry import query


@query("""with g as (select user_id, event_type, value > 50 as hi, count(*) as n from events where event_type <> 'click' group by all),
o as (select user_id, ts::date as d, event_type, event_id, event_id % 97 = 0 as x from events),
per as (select user_id, d, event_type, count(*) as n, bool_or(x) as x from o group by all),
s as (select user_id, d, sum(n)::bigint as observations, sum(n - 1)::bigint as duplicates, count(distinct event_type)::integer as families, bool_or(x) as contradicted from per group by all)
select user_id, d as day, observations, duplicates, families, case when contradicted then 'CONTRADICTORY' when duplicates = observations - 1 then 'DUPLICATE_ONLY' when families > 1 then 'INDEPENDENT' when observations > 1 then 'MULTIPLE_OBSERVATIONS_ONE_FAMILY' else 'REPEATED_WITHIN_SOURCE' end as status from s""")
def corroboration(t):
    o = t.events.select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("observation_id"), F.col("event_type").alias("source_family"), F.col("event_type").alias("derivative_group"), (F.col("event_id") % 97 == 0).alias("contradicts"))
    return co.corroboration(o, ["user_id", "day"])


@query("""with d as (select user_id, strftime(ts, '%G-%V') as w, min(ts::date) as ts, count(*) as n from events group by all), g as (select user_id, list(n order by ts) as v from d where ts <= date '2024-01-31' group by 1 having count(*) >= 2),
x as (select user_id, len(v) as snapshots, v[1] as first, v[-1] as last, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) as c from g),
y as (select *, len(list_filter(c, lambda q: q > 0)) > 0 and len(list_filter(c, lambda q: q < 0)) > 0 as contradiction, len(list_filter(c, lambda q: q <> 0)) as moved from x),
z as (select *, (last - first) / first::double as rel, case when last > first then 'hiring_expansion' when last < first then 'hiring_contraction' end as candidate_type from y),
f as (select *, list_filter([case when snapshots >= 4 and candidate_type is not null then null else 'history_depth' end, case when abs(rel) >= 0.1 and candidate_type is not null then null else 'magnitude' end,
  case when (case when contradiction then 0 else moved end) >= 3 and candidate_type is not null then null else 'persistence' end, case when not contradiction then null else 'contradiction' end], lambda q: q is not null) as failed from z)
select user_id, candidate_type, round(rel, 9) as relative_change, array_to_string(failed, ',') as failed, case when candidate_type is null then 'WITHHELD' when len(failed) = 0 then 'QUALIFIED' else 'INSUFFICIENT_EVIDENCE' end as status,
  case when candidate_type is not null and len(failed) = 0 then case when rel > 0 then 'INCREASING' else 'DECREASING' end else 'UNKNOWN' end as direction from f""")
def qualify_condition(t):
    iso = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    d = t.events.groupBy("user_id", iso.alias("w")).agg(F.min(F.to_date("ts")).alias("ts"), F.count(F.lit(1)).alias("open_count")).withColumn("healthy", F.lit(True))
    out = co.qualify(co.hiring_candidates(d, ["user_id"], "2024-01-31").drop("healthy"))
    return out.select("user_id", "candidate_type", F.round("relative_change", 9).alias("relative_change"), F.array_join("failed", ",").alias("failed"), "status", "direction")


@query("""with m as (select o_custkey, strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders where o_orderstatus <> 'P' group by all), g as (select o_custkey, list(n order by month) as v from m group by 1 having count(*) >= 2)
select o_custkey, 'procurement_activity_acceleration' as candidate_type, len(v)::integer as months, v[-1] - v[1] as absolute_change, round((v[-1] - v[1]) / v[1]::double, 9) as relative_change from g where v[-1] > v[1]""")
def procurement_candidates(t):
    r = t.orders.withColumn("approved", F.col("o_orderstatus") != "P")
    return co.procurement_candidates(r, ["o_custkey"], "o_orderdate").withColumn("relative_change", F.round("relative_change", 9))


@query("""with p as (select *, count(*) over (partition by c_nationkey) as members, rank() over (partition by c_nationkey order by c_acctbal) - 1 as below, count(*) over (partition by c_nationkey, c_acctbal) as n from customer)
select c_custkey, c_nationkey, members, case when members < 20 then 'suppressed' when members < 30 then 'caution' when members < 50 then 'acceptable' else 'preferred' end as reliability,
  case when members >= 20 then round((below + (n - 1) / 2.0) / (members - 1)::double, 9) end as percentile from p""")
def peer_percentile(t):
    return co.peer_percentile(t.customer, "c_nationkey", "c_custkey", "c_acctbal").withColumn("percentile", F.round("percentile", 9))
