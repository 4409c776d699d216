"""Point-in-time queries on events, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import joins as jo
from tidemark.operators import pointintime as pt
from tidemark.plans.registry import query


@query("select event_id, user_id, event_type from events where ts < timestamp '2024-01-16'")
def as_of_filter(t):
    return pt.as_of(t.events, "2024-01-15", "ts").select("event_id", "user_id", "event_type")


SPANS = "s as (select user_id, event_type, min(ts)::date as first_seen, max(ts)::date as closed_at from events group by all)"


def spans(t):
    return t.events.groupBy("user_id", "event_type").agg(F.to_date(F.min("ts")).alias("first_seen"), F.to_date(F.max("ts")).alias("closed_at"))


@query(f"with {SPANS} select user_id, event_type from s where first_seen <= date '2024-01-28' and (closed_at is null or closed_at > date '2024-01-28')")
def active_as_of(t):
    return pt.active_as_of(spans(t), "2024-01-28").select("user_id", "event_type")


@query(f"with {SPANS}, d as (select distinct ts::date as day from events) select day, (select count(*) from s where first_seen <= day and closed_at > day) as active from d")
def active_on_days(t):
    return pt.active_on_days(spans(t), t.events.select(F.to_date("ts").alias("day")).distinct())


MANIFEST = "m as (select event_id, user_id, case when ts >= timestamp '2024-01-21' then 'EXCLUDED_AFTER_ANALYSIS_CUTOFF' when event_type = 'error' then 'EXCLUDED_COLLECTION_ERROR' else 'INCLUDED' end as reason from events)"


def manifest(t):
    e = t.events.withColumn("health", F.when(F.col("event_type") == "error", "error").otherwise("healthy")).withColumn("collected_at", F.col("ts"))
    return pt.manifest_inclusion(e, "2024-01-20")


@query(f"with {MANIFEST} select event_id, reason, reason = 'INCLUDED' as included from m")
def manifest_inclusion(t):
    return manifest(t).select("event_id", "reason", "included")


@query(f"""with {MANIFEST}, s as (select user_id, event_id % 40 as part, count(*) as records, count(*) filter (reason = 'INCLUDED') as included, count(*) filter (reason = 'EXCLUDED_COLLECTION_ERROR') as failed, count(*) filter (reason = 'EXCLUDED_AFTER_ANALYSIS_CUTOFF') as late from m group by all)
select user_id, part, records, included, failed, late, case when included > 0 then 'AVAILABLE' when failed > 0 then 'FAILED' when late > 0 then 'NO_HISTORY' else 'UNAVAILABLE' end as availability from s""")
def source_availability(t):
    return pt.source_availability(manifest(t).withColumn("part", F.col("event_id") % 40), ["user_id", "part"])


#: Lines of a part of `outcome_window_join`.
PART_LINES = 1_250_000


@query("""with o as (select l_orderkey, max_by(l_returnflag, (l_shipdate, l_linenumber, l_returnflag)) as outcome from lineitem where l_linestatus = 'F' group by 1)
select o_orderkey, outcome, shipped from (select o_orderkey, o_orderdate, outcome, (select count(*) from lineitem l where l.l_orderkey = o_orderkey and l_shipdate > o_orderdate and l_shipdate <= o_orderdate + interval 60 day) as shipped from orders join o on o_orderkey = l_orderkey)""")
def outcome_window_join(t):
    """Lines meet their orders once, in parts of PART_LINES lines, so that a task's memory does not follow the size of the tables."""
    parts = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // PART_LINES))
    orders = t.orders.select("o_orderkey", "o_orderdate", F.monotonically_increasing_id().alias("row")).repartition(parts, "o_orderkey")
    last = ["l_shipdate", "l_linenumber", "l_returnflag"]
    lines = t.lineitem.select("l_orderkey", *last, (F.col("l_linestatus") == "F").alias("final")).repartition(parts, "l_orderkey")
    inside = pt.in_outcome_window(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 60 days"), F.col("l_shipdate"))
    met = lines.join(orders.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "row", *last, "final", inside.alias("inside")).where("final or inside")
    found = met.groupBy("o_orderkey", "row").agg(F.max_by("l_returnflag", F.when(F.col("final") & F.col("l_returnflag").isNotNull(), F.struct(*last))).alias("outcome"), F.count_if("inside").alias("shipped"), F.bool_or("final").alias("final"))
    return found.where("final").select("o_orderkey", "outcome", "shipped")


@query("""with r as (select l_orderkey as o_orderkey, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, c_name, lines, quantity from orders join customer on o_custkey = c_custkey left join r using (o_orderkey)""")
def resolution_left_join(t):
    r = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("prediction_id")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    p = t.orders.select(F.col("o_orderkey").alias("prediction_id"), F.col("o_custkey").alias("company_id"))
    c = t.customer.select(F.col("c_custkey").alias("company_id"), "c_name")
    return pt.predictions_with_resolution(p, c, r).select(F.col("prediction_id").alias("o_orderkey"), "c_name", "lines", "quantity")


@query("select c_custkey, count(o_orderkey) as results, round(avg((o_totalprice / 500000 - 0.5) ** 2), 9) as brier from customer left join orders on o_custkey = c_custkey group by 1")
def backtest_summary(t):
    r = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("result_id"), F.pow(F.col("o_totalprice") / 500000 - 0.5, 2).alias("brier_component"))
    return ev.backtest_summary(t.customer.select("c_custkey"), r, "c_custkey").withColumn("brier", F.round("brier", 9))


@query("""select attribute, max(v) filter (seg = 'BUILDING') as "BUILDING", max(v) filter (seg = 'HOUSEHOLD') as "HOUSEHOLD" from (
select c_mktsegment as seg, 'customers' as attribute, count(*)::double as v from customer group by 1 union all select c_mktsegment, 'balance', round(avg(c_acctbal), 6) from customer group by 1) group by 1""")
def compare_matrix(t):
    g = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("balance"))
    return jo.compare(g, "c_mktsegment", ["BUILDING", "HOUSEHOLD"], ["customers", "balance"])


@query("select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name || ' ' || c_mktsegment), '12 build')")
def search_companies(t):
    return pt.search(t.customer, "12 BUILD", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


def watchlist_of(rows):
    d = rows.groupBy(F.col("user_id").alias("company_id")).agg(F.to_date(F.max("ts")).alias("changed"), F.count(F.when(F.col("event_type") == "signup", 1)).alias("observations"))
    out = pt.watchlist(d, with_observations=True, changed_days=2, order="-changed")
    return out.select(F.col("company_id").alias("user_id"), "changed", F.col("observations").alias("n"))


@query("""with d as (select user_id, max(ts)::date as changed, count(*) filter (event_type = 'signup') as n from events group by 1), m as (select max(changed) as m from d)
select user_id, changed, n from d, m where date_diff('day', changed, m) <= 2 and n > 0""")
def watchlist(t):
    return watchlist_of(t.events)


@query()
def watchlist_whole(t):
    return watchlist_of(t.events)


@query("with d as (select user_id, ts::date as as_of, count(*) as n from events group by all), s as (select unnest([date '2024-01-05', date '2024-01-20']) as as_of), u as (select distinct user_id from events) select user_id, s.as_of, coalesce((select n from d where d.user_id = u.user_id and d.as_of = s.as_of), 0) as arrived, coalesce((select sum(n) from d where d.user_id = u.user_id and d.as_of <= s.as_of), 0)::bigint as available from u, s")
def snapshots_as_of(t):
    spine = t.spark.createDataFrame([("2024-01-05",), ("2024-01-20",)], "d string").select(F.to_date("d").alias("as_of"))
    e = t.events.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("available_at"))
    return pt.snapshots_as_of(e, spine, ["user_id"]).select("user_id", "as_of", F.size("arrived").cast("long").alias("arrived"), "available")


def same_events_of(docs):
    d = docs.select("source", F.col("doc_id").alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("day"), "text")
    return jo.same_events(d, ["source"], 14, 0.4).withColumn("similarity", F.round("similarity", 9))


@query("""with e as (select doc_id, source, date '2024-01-01' + (doc_id % 28)::integer as day, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as tok from documents), n as (select doc_id, count(*) as n from e group by 1),
p as (select a.source, a.doc_id as left_id, b.doc_id as right_id, count(*) as both_ from e a join e b on a.source = b.source and a.tok = b.tok and a.doc_id < b.doc_id and abs(date_diff('day', a.day, b.day)) <= 14 group by all)
select source, left_id, right_id, round(both_ / (x.n + y.n - both_)::double, 9) as similarity from p join n x on x.doc_id = left_id join n y on y.doc_id = right_id where both_ / (x.n + y.n - both_)::double >= 0.4""")
def same_events(t):
    return same_events_of(t.documents)


@query()
def same_events_whole(t):
    return same_events_of(t.documents)


def best_of(docs):
    d = docs.select("source", F.col("doc_id").alias("id"), "text")
    out = jo.best_similarity(d.where("id % 2 = 0"), d.where("id % 2 = 1"), ["source"])
    return out.withColumn("similarity", F.round("similarity", 9))


@query("""with l as (select doc_id as left_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as tok from documents), n as (select left_id, source, count(*) as n from l group by all),
p as (select a.source, a.left_id, b.left_id as right_id, count(*) as both_ from l a join l b on a.source = b.source and a.tok = b.tok and a.left_id % 2 = 0 and b.left_id % 2 = 1 group by all),
s as (select p.source, p.left_id, p.right_id, both_ / (x.n + y.n - both_)::double as sim from p join n x on x.left_id = p.left_id join n y on y.left_id = p.right_id),
b as (select source, left_id, max_by(right_id, (sim, right_id)) as right_id, max(sim) as sim from s where sim >= 0.15 group by all)
select d.source, d.doc_id as left_id, b.right_id, round(b.sim, 9) as similarity, case when b.sim is not null then 'agreed' else 'unmatched' end as match from documents d left join b on b.left_id = d.doc_id where d.doc_id % 2 = 0
union all select source, null, doc_id, null, 'right_only' from documents d where doc_id % 2 = 1 and not exists (select 1 from b where b.right_id = d.doc_id and b.source = d.source)""")
def token_similarity_pairs(t):
    return best_of(t.documents)


@query()
def token_similarity_pairs_whole(t):
    return best_of(t.documents)


@query("""with a as (select 'CUSTOMER 00000000' || i as alias, i % 4 as company_id from range(10) r(i)), k as (select trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) as k, min(company_id) as company_id from a group by 1)
select c_custkey, k.company_id, case when k.company_id is not null then 1.0 else 0.0 end::double as confidence from customer left join k on k.k = trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g'))""")
def alias_resolution(t):
    aliases = t.spark.range(10).select(F.concat(F.lit("CUSTOMER 00000000"), F.col("id").cast("string")).alias("alias"), (F.col("id") % 4).alias("company_id"))
    return jo.resolve_aliases(t.customer, aliases, "c_name").select("c_custkey", "company_id", "confidence")
