"""Queries on orders, lineitem, customers and labels as predictions, decisions and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import extraction as ex
from tidemark.operators import joins as jo
from tidemark.operators import longitudinal as lo
from tidemark.operators import pointintime as pt
from tidemark.operators import scoring as sc
from tidemark.plans.registry import query


@query("""with j as (select lang as family, quality = 1 as supported, coalesce(n_chars > 1500, false) as accepted from documents join labels using (doc_id))
select family, count(*) filter (accepted and supported) as tp, count(*) filter (accepted and not supported) as fp, count(*) filter (not accepted and supported) as missed, count(*) filter (not accepted and not supported) as true_rejection from j group by rollup (family)""")
def confusion_by_family(t):
    labels = t.labels.join(t.documents, "doc_id").select("doc_id", F.col("lang").alias("family"), (F.col("quality") == 1).alias("supported"))
    return ev.confusion_by_family(labels, t.documents.select("doc_id", (F.col("n_chars") > 1500).alias("accepted")), "doc_id")


@query("""with s as (select case when quality = 1 and n_chars < 300 then 'not_generated' when quality = 1 and n_chars < 900 then 'filtered_out' when quality = 1 and n_chars < 1500 then 'rejected_by_verifier' when quality = 0 and n_chars >= 1500 then 'false_accept' else 'none' end as stage from documents join labels using (doc_id))
select stage, count(*) as n, (select count(*) from s where stage <> 'none') as total, round(count(*) / (select count(*) from s where stage <> 'none')::double, 9) as share from s where stage <> 'none' group by 1""")
def failure_stages(t):
    d = t.documents.join(t.labels, "doc_id").select((F.col("n_chars") >= 300).alias("generated"), (F.col("n_chars") >= 900).alias("filtered"), (F.col("n_chars") >= 1500).alias("verified"), (F.col("quality") == 1).alias("supported"))
    return ev.failure_stages(d).withColumn("share", F.round("share", 9))


@query("""with c as (select o_orderpriority as family, case o_orderstatus when 'F' then 'accept' when 'O' then 'reject' else 'ambiguous' end as expected, case when o_orderkey % 211 = 0 then 'accept' when o_orderstatus = 'F' then 'accept' when o_orderstatus = 'O' then 'reject' else 'ambiguous' end as actual, 'k' || o_orderkey % 4 as kind from orders),
g as (select family, bool_or(expected = 'accept') as positive, bool_or(expected = 'reject') as negative, bool_or(expected = 'ambiguous') as ambiguous, array_to_string(list_sort(list(distinct kind)), ',') as seen, count(*) filter (expected <> actual) as mismatches, list(distinct kind) as ks from c group by 1)
select family, positive, negative, ambiguous, seen, mismatches, case when positive and negative and ambiguous and list_contains(ks, 'k0') and list_contains(ks, 'k3') and mismatches = 0 then 'READY' else 'NOT_READY' end as status from g""")
def readiness_checklist(t):
    expected = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "reject").otherwise("ambiguous")
    c = t.orders.select(F.col("o_orderpriority").alias("family"), expected.alias("expected"), F.when(F.col("o_orderkey") % 211 == 0, "accept").otherwise(expected).alias("actual"), F.concat(F.lit("k"), (F.col("o_orderkey") % 4).cast("string")).alias("kind"))
    return ev.readiness_checklist(c, ["k0", "k3"]).withColumn("seen", F.array_join("seen", ","))


@query("""with m as (select c_acctbal as gold_value, case when c_custkey % 10 = 0 then -c_acctbal when c_custkey % 10 = 1 then c_acctbal * 1000 else c_acctbal end as value, c_nationkey as gold_period, c_nationkey + (c_custkey % 7 = 0)::int as period, c_mktsegment as gold_basis, case when c_custkey % 11 = 0 then 'X' else c_mktsegment end as basis from customer)
select count(*) filter (sign(value) * sign(gold_value) < 0) as wrong_sign, count(*) filter (period <> gold_period) as wrong_period, count(*) filter (greatest(abs(value), abs(gold_value)) >= 1000 * least(abs(value), abs(gold_value)) and value <> gold_value) as wrong_scale, count(*) filter (basis <> gold_basis) as wrong_basis from m""")
def severe_errors(t):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    m = t.customer.select(b.alias("gold_value"), F.when(k % 10 == 0, -b).when(k % 10 == 1, b * 1000).otherwise(b).alias("value"), F.col("c_nationkey").alias("gold_period"), (F.col("c_nationkey") + (k % 7 == 0).cast("int")).alias("period"), F.col("c_mktsegment").alias("gold_basis"), F.when(k % 11 == 0, "X").otherwise(F.col("c_mktsegment")).alias("basis"))
    return ev.severe_errors(m)


@query("""with p as (select p_partkey, p_retailprice + (p_partkey % 5 = 0)::int as value, p_brand, true as found from part where p_partkey % 3 <> 0)
select g.p_partkey, coalesce(p.found, false) as found, coalesce(abs(g.p_retailprice - p.value) <= 1e-6 * greatest(1.0, abs(g.p_retailprice)), false) as same_value, coalesce(p.found, false) and g.p_brand is not distinct from p.p_brand as same_p_brand from part g left join p using (p_partkey)""")
def numeric_match(t):
    gold = t.part.select("p_partkey", F.col("p_retailprice").alias("value"), "p_brand")
    p = gold.where("p_partkey % 3 <> 0").withColumn("value", F.col("value") + (F.col("p_partkey") % 5 == 0).cast("int"))
    return ev.numeric_match(p, gold, ["p_partkey"], ["p_brand"])


@query("select quality as label, count(*) as labelled, count(*) filter (doc_id % 3 = 0) as retained, round(count(*) filter (doc_id % 3 = 0) / count(*)::double, 9) as retention from labels group by 1")
def retained_labels(t):
    return jo.retained_labels(t.documents.where("doc_id % 3 = 0"), t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id").withColumn("retention", F.round("retention", 9))


@query("""with d as (select l_orderkey, min(case l_returnflag when 'A' then 'accept' when 'R' then 'reject' else 'odd' end) as d, count(distinct l_returnflag) as n from lineitem group by 1)
select o_orderkey, case when n = 1 and d <> 'odd' then d else 'ambiguous' end as decision, coalesce(n = 1 and d <> 'odd', false) as replayed from orders left join d on l_orderkey = o_orderkey""")
def replay_decisions(t):
    d = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "R", "reject").otherwise("odd").alias("decision"))
    return jo.replay_decisions(t.orders.select("o_orderkey"), d, "o_orderkey")


@query("""with a as (select 'Part ' || p_partkey as alias, p_partkey % 50 as company_id from part where p_partkey < 100 union all select 'PART ' || p_partkey || ' ltd', p_partkey % 7 from part where p_partkey < 20),
k as (select list_filter(string_split(trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> 'ltd') as k, count(distinct company_id) as n, min(company_id) as id from a group by 1)
select p_partkey, case when n = 1 then id end as company_id, case when n = 1 then 'accepted' else 'manual_review' end as resolution from part left join k on k.k = ['part', p_partkey::varchar]""")
def supplier_resolution(t):
    p = t.part.select("p_partkey", F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("supplier"))
    a = p.where("p_partkey < 100").select(F.col("supplier").alias("alias"), (F.col("p_partkey") % 50).alias("company_id"))
    b = p.where("p_partkey < 20").select(F.concat(F.upper("supplier"), F.lit(" ltd")).alias("alias"), (F.col("p_partkey") % 7).alias("company_id"))
    return jo.resolve_suppliers(p, a.unionByName(b)).select("p_partkey", "company_id", "resolution")


@query("select s_suppkey as entity, s_nationkey % 7 as parent, case when n.n_nationkey is null then 'unknown_entity' else 'other_parent' end as violation from supplier left join nation n on n.n_nationkey = s_suppkey where n.n_nationkey is null or n.n_regionkey is distinct from s_nationkey % 7")
def parent_violations(t):
    return jo.parent_violations(t.supplier.select(F.col("s_suppkey").alias("entity"), (F.col("s_nationkey") % 7).alias("parent")), t.nation.select(F.col("n_nationkey").cast("long").alias("entity"), F.col("n_regionkey").alias("parent")))


@query("select distinct c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def partition_leakage(t):
    return jo.leakage(t.customer, [t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))], "c_custkey")


@query("""with s as (select event_type, ts::date as ts from events group by all), l as (select event_type, user_id, min(ts)::date as first_seen, max(ts)::date as last_seen, case when max(ts)::date < date '2024-01-25' then max(ts)::date + 2 end as closed_at, (user_id % 3)::int as misses, (user_id % 4)::int as reopened from events group by all),
m as (select *, ts = max(ts) over (partition by event_type) as is_latest from s)
select event_type, ts, is_latest, count(*) filter (first_seen = ts) as new, count(*) filter (first_seen < ts and last_seen >= ts) as persistent, count(*) filter (closed_at <= ts) as closed, count(*) filter (is_latest and misses = 1) as absent_once, sum(case when is_latest then coalesce(reopened, 0) else 0 end)::bigint as reopened from m left join l using (event_type) group by all""")
def careers_history(t):
    return careers_history_of(t.events, t.events)


@query()
def careers_history_whole(t):
    return careers_history_of(t.events, t.events)


def careers_history_of(e, known):
    s = e.select("event_type", F.to_date("ts").alias("ts")).distinct()
    life = known.groupBy("event_type", "user_id").agg(F.to_date(F.min("ts")).alias("first_seen"), F.to_date(F.max("ts")).alias("last_seen"))
    life = life.withColumn("closed_at", F.when(F.col("last_seen") < F.lit("2024-01-25").cast("date"), F.date_add("last_seen", 2))).withColumn("misses", F.col("user_id") % 3).withColumn("reopened", F.col("user_id") % 4)
    return lo.careers_history(s, life, ["event_type"])


def mix_trajectory_of(rows):
    iso = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    e = rows.select("user_id", F.col("event_type").alias("key"), iso.alias("ts"))
    s = e.select("user_id", "ts").distinct().withColumn("legacy", F.col("ts") == "2024-02")
    out = lo.mix_trajectory(e.groupBy("user_id", "key", "ts").agg(F.count(F.lit(1)).alias("n")), s, ["user_id"])
    return out.select("user_id", "key", F.array_join(F.transform("counts", lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",").alias("counts"))


@query("""with s as (select distinct user_id, strftime(ts, '%G-%V') as ts from events), k as (select distinct user_id, event_type as key from events), n as (select user_id, event_type as key, strftime(ts, '%G-%V') as ts, count(*) as n from events group by all)
select user_id, key, array_to_string(list(coalesce(case when s.ts = '2024-02' then 'null' else coalesce(n.n, 0)::varchar end, 'null') order by s.ts), ',') as counts from k join s using (user_id) left join n using (user_id, key, ts) group by all""")
def mix_trajectory(t):
    return mix_trajectory_of(t.events)


@query()
def mix_trajectory_whole(t):
    return mix_trajectory_of(t.events)


@query("""with f as (select user_id as company, ts::date as ts, case when event_type = 'view' then 'observation' else event_type end as kind, count(*) as n from events group by all), c as (select distinct company, ts from f where kind <> 'observation'),
r as (select *, row_number() over (partition by company order by ts desc) as r from c), m as (select company, max(case when r = 1 then ts end) as l, max(case when r = 2 then ts end) as b from r group by 1)
select company, ts, kind, n from f left join m using (company) where (kind <> 'observation' and ts = l) or (kind = 'observation' and (b is null or ts > b))""")
def since_previous(t):
    kind = F.when(F.col("event_type") == "view", "observation").otherwise(F.col("event_type"))
    return lo.since_previous(t.events.groupBy(F.col("user_id").alias("company"), F.to_date("ts").alias("ts"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")))


@query("""with e as (select user_id as company, max(ts) filter (event_type = 'click')::date as a, max(ts) filter (event_type = 'error' and value > 90)::date as b from events group by 1)
select c_custkey as company, coalesce(greatest(a, b), date '2020-01-01') as latest from customer left join e on company = c_custkey""")
def latest_dates(t):
    c = t.customer.select(F.col("c_custkey").alias("company"), F.lit("2020-01-01").cast("date").alias("fallback"))
    e = t.events.select(F.col("user_id").alias("company"), F.to_date("ts").alias("d"), "event_type", "value")
    return lo.latest_dates(c, (e.where("event_type = 'click'"), "d"), (e.where("event_type = 'error' and value > 90"), "d")).select("company", "latest")


@query("""with c as (select lower(trim(p_name)) || '|' || lower(p_brand) as k, max_by(p_partkey, (p_size, p_partkey)) as repost_of from part where p_partkey < 1000 group by 1)
select p_partkey, repost_of from part left join c on k = lower(trim(p_name)) || '|' || lower(p_brand) where p_partkey >= 1000""")
def repost_links(t):
    p = t.part.select("p_partkey", F.col("p_partkey").alias("identity"), F.col("p_name").alias("title"), F.col("p_brand").alias("location"), F.col("p_size").alias("closed_at"))
    return lo.link_reposts(p.where("p_partkey >= 1000").drop("identity", "closed_at"), p.where("p_partkey < 1000")).select("p_partkey", "repost_of")


@query("""with y as (select o_custkey, strftime(o_orderdate, '%Y') as period, round(sum(o_totalprice), 2) as value, min(o_orderkey) as id from orders group by all), w as (select *, lead(period) over p as prior_period, lead(value) over p as pv, lead(id) over p as pid, row_number() over p as r from y window p as (partition by o_custkey order by period desc))
select o_custkey, prior_period, period, round((value - pv) / abs(pv) * 100, 7) as pct_change, pid || ',' || id as inputs from w where r = 1 and pv is not null and pv <> 0""")
def feature_pairs(t):
    y = t.orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy").alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.min("o_orderkey").alias("id")).withColumns({"currency": F.lit("USD"), "annual": F.lit(True)})
    return lo.feature_pairs(y, ["o_custkey"]).withColumn("pct_change", F.round("pct_change", 7)).withColumn("inputs", F.array_join(F.col("inputs").cast("array<string>"), ","))


def components(t):
    return t.events.select("user_id", F.least(F.lit(1.0), F.abs("value") / 1000).alias("strength"), F.lit(0.9).alias("reliability"), F.lit(0.5).alias("materiality"), F.lit(0.7).alias("recency"), F.lit(0.8).alias("independence"), F.lit(1.0).alias("relevance"), F.when(F.col("event_type") == "error", -1.0).otherwise(1.0).alias("direction"))


COMPONENTS = "c as (select user_id, least(1.0, abs(value) / 1000) as s, case when event_type = 'error' then -1.0 else 1.0 end as d from events)"


@query(f"with {COMPONENTS} select user_id, round_even(greatest(0.0, least(100.0, 50 + 50 * sum(s * 0.9 * 0.5 * 0.7 * 0.8 * d))), 0)::integer as score, round_even(least(100.0, 100 * 0.9 * (1 - 1 / (1 + sum(s * 0.8)))), 0)::integer as confidence from c group by 1")
def weighted_score(t):
    return sc.weighted_score(components(t), ["user_id"])


@query(f"with {COMPONENTS} select user_id, round(sum(s * 0.9 * 0.5 * 0.7 * 0.8 * d) * 1.35, 9) as score, round(least(0.85::double, 0.20::double + 0.055::double * count(*) * 0.8::double), 9) as confidence from c group by 1")
def pilot_score(t):
    return sc.pilot_score(components(t), ["user_id"]).withColumns({c: F.round(c, 9) for c in ("score", "confidence")})


@query("""select o_orderkey, status from (select o_orderkey, case when o_orderkey % 13 = 0 then 'EXCLUDED' when e.k is not null and f.k is not null then 'COMPLETE' when e.k is not null then 'FEATURES_MISSING' when o_orderkey % 2 = 0 and o_orderstatus = 'P' then 'SOURCE_FAILED' when o_orderkey % 2 = 0 then 'EVIDENCE_MISSING' else 'NO_SOURCE' end as status
from orders left join (select distinct l_orderkey as k from lineitem where l_returnflag = 'R') e on e.k = o_orderkey left join (select distinct l_orderkey as k from lineitem where l_tax > 0.07) f on f.k = o_orderkey)""")
def coverage_status(t):
    o, key = t.orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey").alias("o_orderkey")
    sources = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"))
    out = pt.coverage_status(o.select("o_orderkey"), t.lineitem.where("l_returnflag = 'R'").select(key), t.lineitem.where("l_tax > 0.07").select(key), o.where("o_orderkey % 13 = 0"), sources, "o_orderkey")
    return out.select("o_orderkey", "status")


def occasion_completeness_of(rows):
    r = rows.select("c_custkey", "c_mktsegment")
    out = pt.completeness(r, {"evidence": r.where("c_custkey % 3 <> 0"), "outcomes": r.where("c_custkey % 50 <> 0")}, "c_custkey", "c_mktsegment")
    return out.withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query("""with k(kind) as (values ('evidence'), ('outcomes')), r as (select c_custkey, c_mktsegment from customer)
select c_mktsegment, kind, count(*) as required, count(*) filter (case kind when 'evidence' then c_custkey % 3 <> 0 else c_custkey % 50 <> 0 end) as covered, array_to_string(coalesce(list(c_custkey order by c_custkey) filter (not case kind when 'evidence' then c_custkey % 3 <> 0 else c_custkey % 50 <> 0 end), []), ',') as missing from r, k group by all""")
def occasion_completeness(t):
    return occasion_completeness_of(t.customer)


@query()
def occasion_completeness_whole(t):
    return occasion_completeness_of(t.customer)


@query("select c_custkey, next_at is null or timestamp '2024-01-20 00:00:00' >= next_at as due from customer left join (select user_id, max(ts) + interval 5 day as next_at from events where event_type = 'signup' group by 1) on user_id = c_custkey")
def due_sources(t):
    state = t.events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("c_custkey")).agg((F.max("ts") + F.expr("interval 5 days")).alias("next_eligible_at"))
    return pt.due(t.customer.select("c_custkey"), state, "2024-01-20 00:00:00", ["c_custkey"]).select("c_custkey", "due")


@query("""with s as (select c_nationkey, lower(c_name) as t from customer group by all), a as (select c_nationkey, count(*) as total, count(*) filter (regexp_matches(t, '1')) as ones, count(*) filter (regexp_matches(t, '99')) as nines from s group by 1),
l as (select c_nationkey, total, unnest([{'role': 'ones', 'n': ones}, {'role': 'nines', 'n': nines}]) as p from a)
select c_nationkey, p.role as role, p.n as n, round(p.n / total::double, 9) as share, round(least(1.0, p.n / total::double / 0.40), 9) as strength, round(least(1.0, p.n / 5.0::double), 9) as materiality from l where p.n > 0""")
def role_shares(t):
    return lo.role_shares(t.customer, ["c_nationkey"], "c_name", {"ones": "1", "nines": "99"}).withColumns({c: F.round(c, 9) for c in ("share", "strength", "materiality")})


def merge_events_of(rows):
    e = rows.select(F.col("user_id").alias("company"), "event_type", F.to_date("ts").alias("period"), F.col("props").alias("span"), F.col("event_id").alias("observation_id"), F.col("value").alias("attributes"))
    return lo.merge_events(e).withColumn("observation_ids", F.array_join(F.col("observation_ids").cast("array<string>"), ","))


@query("""select user_id as company, event_type, ts::date as period, trim(regexp_replace(lower(props), '[^a-z0-9]+', ' ', 'g')) as span_key, array_to_string(list_sort(list(distinct event_id)), ',') as observation_ids, min_by(value, event_id) as attributes from events group by all""")
def merge_events(t):
    return merge_events_of(t.events)


@query()
def merge_events_whole(t):
    return merge_events_of(t.events)


@query("""with a as (select p_partkey, p_retailprice as v, p_brand as b, p_size as s from part where p_partkey % 7 <> 0), e as (select p_partkey, case p_partkey % 9 when 0 then -p_retailprice when 1 then p_retailprice * 1000 when 2 then p_retailprice + 1 else p_retailprice end as v, case when p_partkey % 8 = 0 then 'X' else p_brand end as b, p_size + (p_partkey % 10 = 3)::int as s from part where p_partkey % 5 <> 0)
select coalesce(a.p_partkey, e.p_partkey) as p_partkey, case when e.p_partkey is null then 'annotation_only' when a.p_partkey is null then 'extraction_only' when a.s <> e.s then 'period' when a.b <> e.b then 'currency' when a.v = e.v then 'agreed' when a.v = -e.v then 'sign' when abs(greatest(abs(a.v), abs(e.v)) / least(abs(a.v), abs(e.v))) = 1000 then 'scale' else 'value' end as class from a full join e on a.p_partkey = e.p_partkey""")
def numeric_classes(t):
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    a = t.part.where("p_partkey % 7 <> 0").select("p_partkey", v.alias("value"), F.col("p_brand").alias("currency"), F.col("p_size").alias("period"), F.lit("b").alias("basis"))
    e = t.part.where("p_partkey % 5 <> 0").select("p_partkey", F.when(k % 9 == 0, -v).when(k % 9 == 1, v * 1000).when(k % 9 == 2, v + 1).otherwise(v).alias("value"), F.when(k % 8 == 0, "X").otherwise(F.col("p_brand")).alias("currency"), (F.col("p_size") + (k % 10 == 3).cast("int")).alias("period"), F.lit("b").alias("basis"))
    return ex.compare_numeric(a, e, ["p_partkey"]).select("p_partkey", "class")


@query("""with d as (select doc_id, [case when n_chars > 3000 then 'long' end, case when contains(text, '|') then 'table' end, case when regexp_matches(text, '[0-9]') then 'figures' end, case when contains(text, '###') then 'noise' end, case when lang <> 'en' then 'foreign' end] as f from documents)
select doc_id, array_to_string(list_filter(f, lambda x: x is not null), ',') as flags, len(list_filter(f, lambda x: x is not null)) >= 3 as difficult from d""")
def difficulty_flags(t):
    text = F.col("text")
    probes = {"long": F.col("n_chars") > 3000, "table": text.contains("|"), "figures": text.rlike("[0-9]"), "noise": text.contains("###"), "foreign": F.col("lang") != "en"}
    return ex.difficulty(t.documents, probes).select("doc_id", F.array_join("flags", ",").alias("flags"), "difficult")
