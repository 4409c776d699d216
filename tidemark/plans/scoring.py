"""Scoring queries on lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scoring as sc
from tidemark.plans.registry import query


def rounded(df, *names, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("""with r as (select l_orderkey, l_linenumber, l_discount * 5 as pressure_language, l_tax * 10 as margin_pressure, l_quantity / 50 as cash_pressure, l_linenumber / 10.0::double as contrary_strength from lineitem),
s as (select *, pressure_language between 0 and 1 and margin_pressure between 0 and 1 and cash_pressure between 0 and 1 and contrary_strength between 0 and 1 as ok from r)
select l_orderkey, l_linenumber, case when ok then round_even(1 / (1 + exp(-(ln(0.12 / 0.88) + 1.4 * pressure_language + 0.9 * margin_pressure + 0.7 * cash_pressure - 0.8 * contrary_strength))), 6) end as probability from s""")
def rules_score(t):
    r = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 5).alias("pressure_language"), (F.col("l_tax") * 10).alias("margin_pressure"), (F.col("l_quantity") / 50).alias("cash_pressure"), (F.col("l_linenumber") / F.lit(10.0)).alias("contrary_strength"))
    return sc.rules_score(r).select("l_orderkey", "l_linenumber", "probability")


@query("""with p as (select o_custkey, sum((o_orderstatus = 'F')::int) as s, count(*) as c from orders group by 1)
select o_custkey, round((sum(s) over () - s) / nullif(sum(c) over () - c, 0)::double, 9) as rate from p""")
def loco_baseline(t):
    o = t.orders.withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return rounded(sc.leave_company_out_rate(o, "o_custkey", "label"), "rate")


WEIGHTS = {"signup": 0.22, "view": 0.10, "purchase": 0.16, "click": 0.12}


def evidence(t):
    return t.events.select(
        F.col("user_id").alias("company_id"),
        F.col("event_type").alias("family"),
        F.lit("vacancy_spike").alias("feature"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("cluster"),
        F.to_date("ts").alias("event_date"),
        F.col("ts").alias("available_at"),
        F.least(F.lit(1.0), F.abs("value") / 100).alias("strength"),
        F.lit(0.9).alias("reliability"),
        F.lit(0.8).alias("quality"),
        F.lit(0.7).alias("materiality"),
        F.lit(1.0).alias("independence"),
        F.lit(1.0).alias("relevance"),
        F.when(F.col("event_type") == "view", -1.0).otherwise(1.0).alias("direction"),
        (F.col("event_type") == "click").alias("own_source"),
    )


EVIDENCE_SQL = """with e as (select user_id as company_id, user_id::varchar || '|' || ts::date::varchar as cluster, event_type, ts::date as d,
  case event_type when 'signup' then 0.22 when 'view' then 0.10 when 'purchase' then 0.16 when 'click' then 0.12 end::double * least(1.0, abs(value) / 100) * 0.9 * 0.8 * 0.7
  * exp(-ln(2) * greatest(0, date_diff('day', ts::date, date '2024-01-20')) / 90.0::double) * (case when event_type = 'view' then -1.0 else 1.0 end) as raw from events where ts::date <= date '2024-01-20'),
k as (select company_id, cluster, sum(raw) as total from e where raw is not null group by all),
c as (select e.*, raw * case when total <> 0 then least(1.0, 0.20 / abs(total)) else 1.0 end as contribution from e left join k using (company_id, cluster)),
s as (select company_id, coalesce(sum(contribution), 0.0) as evidence_sum, count(distinct cluster) as clusters, bool_and(event_type = 'click') as own from c group by 1)
select company_id, round(evidence_sum, 7) as evidence_sum, round(1 / (1 + exp(-(ln(0.2 / 0.8) + 5 * evidence_sum))), 7) as probability, clusters, round(least(0.8::double * 0.9 * (1 - exp(-clusters / 3.0::double)), case when clusters < 2 then 0.55 else 1.0 end, case when own then 0.7 else 1.0 end), 7) as confidence from s"""


@query(EVIDENCE_SQL)
def evidence_model(t):
    out = sc.evidence_model(evidence(t), "2024-01-20", WEIGHTS)
    return rounded(out.select("company_id", "evidence_sum", "probability", "clusters", "confidence"), "evidence_sum", "probability", "confidence", digits=7)


@query("""with e as (select user_id, 'restructuring_announced' as target, sum(case when event_type <> 'error' then value / 1000 else -abs(value) / 1000 end) as signed from events group by 1)
select user_id, target, round_even(1 / (1 + exp(-(ln(0.12 / 0.88) + 4 * signed))), 6) as probability from e""")
def target_probability(t):
    e = t.events.select("user_id", F.lit("restructuring_announced").alias("target"), F.when(F.col("event_type") != "error", "supports").otherwise("contradicts").alias("relationship"), (F.col("value") / 1000).alias("value"))
    return sc.target_probability(e, ["user_id"]).select("user_id", "target", "probability")


@query("""with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by abs(l_extendedprice * (l_discount - 0.05)) desc, l_linenumber) as place from lineitem) select l_orderkey, l_linenumber, place::integer as place from r where place <= 2""")
def top_contributions(t):
    r = t.lineitem.withColumn("v", F.col("l_extendedprice") * (F.col("l_discount") - 0.05))
    return sc.top_contributions(r, ["l_orderkey"], "v", 2, ["l_linenumber"]).select("l_orderkey", "l_linenumber", "place")


@query("select c_custkey, (((c_acctbal >= 6000)::int + (c_nationkey >= 15)::int + 1) / 5.0)::double as p from customer")
def financial_stress(t):
    return t.customer.select("c_custkey", sc.financial_stress(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25).alias("p"))
