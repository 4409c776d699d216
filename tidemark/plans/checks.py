"""Queries on record contracts, cutoffs, parsed values and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse as pa
from tidemark.functions import text as tx
from tidemark.operators import integrity as it
from tidemark.operators import longitudinal as lo
from tidemark.operators import pointintime as pt
from tidemark.operators import sampling as sa
from tidemark.operators import scoring as sc
from tidemark.plans.registry import query
from tidemark.streaming import lifecycle as lc


def choice(values: list, key: str):
    """One of the values, which may be null, by the key."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def choice_sql(values: list, key: str) -> str:
    """`choice` in SQL."""
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{key} % {len(values)} + 1]"


# Title, department, function and seniority that they must give.
ROLES = [
    ("Data Engineer", None, "data_ai", "individual_contributor"),
    ("Head of Platform", "Sales", "engineering", "vp_executive"),
    ("Product Manager", None, "product", "manager"),
    ("Account Executive", None, "sales", "individual_contributor"),
    ("Brand Director", "", "marketing", "director"),
    ("Tax Accountant", None, "finance", "individual_contributor"),
    ("Team Lead", "Talent", "hr_people", "manager"),
    ("Privacy Counsel", None, "legal_compliance", "individual_contributor"),
    ("Customer Success Agent", None, "customer_service", "individual_contributor"),
    ("Plant Supervisor", "Site", "operations", "manager"),
    ("Software Engineer, AI platform", None, "data_ai", "individual_contributor"),
    ("Vice President Sales", None, "sales", "vp_executive"),
    ("Cook", "Kitchen", "other_unknown", "individual_contributor"),
    ("  ", None, "other_unknown", "unknown"),
    (None, None, "other_unknown", "unknown"),
]


@query(f"select p_partkey, {choice_sql([r[2] for r in ROLES], 'p_partkey')} as function, {choice_sql([r[3] for r in ROLES], 'p_partkey')} as seniority from part")
def job_roles(t):
    title, department = (choice([r[k] for r in ROLES], "p_partkey") for k in (0, 1))
    return t.part.select("p_partkey", pa.job_function(title, department).alias("function"), pa.job_seniority(title).alias("seniority"))


# Location, and the country, region and city that it must give.
LOCATIONS = [
    ("Austin, Texas, United States", "United States", "Texas", "Austin"),
    ("Remote, USA", "United States", None, None),
    ("London, UK", "United Kingdom", None, "London"),
    ("Nantes , Pays de la Loire , France", "France", "Pays de la Loire", "Nantes"),
    ("Ireland", "Ireland", None, "Ireland"),
    ("Various, Canada, Germany", "Canada", "Canada", None),
    ("", None, None, None),
    (None, None, None, None),
]


@query("select p_partkey, " + ", ".join(f"{choice_sql([x[k] for x in LOCATIONS], 'p_partkey')} as {name}" for k, name in ((1, "country"), (2, "region"), (3, "city"))) + " from part")
def locations(t):
    return t.part.select("p_partkey", pa.geography(choice([x[0] for x in LOCATIONS], "p_partkey")).alias("g")).select("p_partkey", "g.country", "g.region", "g.city")


# Text around a number, the factor that it must be taken by, and its unit.
FIGURES = [("revenue of £{}m", 1.0, "GBP"), ("USD {} billion", 1000.0, "USD"), ("a €{}k grant", 0.001, "EUR"), ("${}", 1e-6, "USD"), ("up {} per cent", 1.0, "percent"), ("-{}% margin", -1.0, "percent"), ("leverage of {}x", 1.0, "ratio"), ("no figure", None, None)]


@query(f"select p_partkey, round((p_size + 0.5) * ([{', '.join('null' if f is None else str(f) for _, f, _ in FIGURES)}])[p_partkey % {len(FIGURES)} + 1]::double, 9) as value, {choice_sql([u for _, _, u in FIGURES], 'p_partkey')} as unit from part")
def amounts(t):
    text = F.replace(choice([x for x, _, _ in FIGURES], "p_partkey"), F.lit("{}"), F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return t.part.select("p_partkey", pa.amount(text).alias("a")).select("p_partkey", F.round("a.value", 9).alias("value"), "a.unit")


CELLS = ["({})", " £ {} ", "{}%", "—", "n/a", None]


@query("""select l_orderkey, l_linenumber, case l_partkey % 6 when 0 then -v when 1 then v when 2 then v end::double as cell, case when l_partkey % 6 > 2 then null when l_suppkey % 2 = 0 or l_partkey % 6 = 0 then -v else v end::double as tagged
from (select *, l_partkey * 1000 + l_linenumber as v from lineitem)""")
def cell_numbers(t):
    number = F.format_number(F.col("l_partkey") * 1000 + F.col("l_linenumber"), 0)
    cell = F.replace(choice(CELLS, "l_partkey"), F.lit("{}"), number)
    sign = F.when(F.col("l_suppkey") % 2 == 0, "-")
    tagged = pa.ixbrl_number(F.concat(F.lit("<b>"), cell, F.lit("</b>")), sign)
    return t.lineitem.select("l_orderkey", "l_linenumber", pa.cell_number(cell).alias("cell"), tagged.alias("tagged"))


@query("select event_id, case event_id % 3 when 0 then epoch_us(ts) when 1 then epoch_us(ts - interval 2 hour) end as us from events")
def iso_timestamps(t):
    at = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    text = F.when(F.col("event_id") % 3 == 0, F.concat(at, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(at, F.lit("+02:00"))).otherwise("not a time")
    return t.events.select("event_id", F.unix_micros(pa.iso_timestamp(text)).alias("us"))


@query("""with p as (select doc_id, unnest(string_split(text, 'en')) as part, generate_subscripts(string_split(text, 'en'), 1) as i from documents),
o as (select doc_id, i, sum(length(part) + 2) over (partition by doc_id order by i) - 2 as pos, count(*) over (partition by doc_id) as parts from p)
select doc_id, count(*) filter (i < parts) as n, min(pos) filter (i < parts)::bigint as first_at, max(pos) filter (i < parts)::bigint as last_at, coalesce(sum(pos) filter (i < parts), 0)::bigint as total from o group by 1""")
def span_positions(t):
    at = t.documents.select("doc_id", tx.span_offsets(F.col("text"), F.lit("en")).alias("at")).select("doc_id", F.explode_outer("at").alias("at"))
    return at.groupBy("doc_id").agg(F.count("at").alias("n"), F.min("at").cast("long").alias("first_at"), F.max("at").cast("long").alias("last_at"), F.coalesce(F.sum("at"), F.lit(0)).cast("long").alias("total"))


def _rules_sql(source: str, keys: str, rules: dict[str, str]) -> str:
    """keys, rule: each rule that does not hold in the rows of `source`."""
    return f"select * from (select {keys}, unnest([" + ", ".join(f"case when coalesce({c}, false) then null else '{k}' end" for k, c in rules.items()) + f"]) as rule from ({source})) where rule is not null"


@query(_rules_sql(
    "select *, l_shipdate + to_days((l_suppkey % 5 - 1)::integer) as collected, l_discount * 20 as confidence, l_linenumber % 3 as state, l_returnflag = 'R' as llm from lineitem",
    "l_orderkey, l_linenumber, l_partkey",
    {
        "available_before_collected": "l_shipdate <= collected",
        "confidence_in_range": "confidence >= 0 and confidence <= 1",
        "span_not_blank": "l_partkey % 11 <> 0",
        "status_known": "l_linenumber <> 4",
        "model_named": "not llm or l_partkey % 2 = 0",
        "correction_has_value": "case when l_linenumber = 4 then true else state <> 2 or l_tax > 0.02 end",
    },
))
def evidence_contract(t):
    c, n = F.col, F.col("l_linenumber")
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", c("l_shipdate").alias("available_at"), F.expr("l_shipdate + make_dt_interval(l_suppkey % 5 - 1)").alias("collected_at"), (c("l_discount") * 20).alias("confidence"),
        F.when(c("l_partkey") % 11 == 0, "  ").otherwise("shipped").alias("span"), F.when(n == 4, "lost").when(n % 3 == 2, "corrected").when(n % 3 == 1, "accepted").otherwise("pending").alias("status"),
        F.when(c("l_returnflag") == "R", "llm").otherwise("rule").alias("method"), F.when(c("l_partkey") % 2 == 0, "m").alias("model"), F.when(c("l_tax") > 0.02, c("l_tax")).alias("corrected_value"),
    )
    return it.check(rows, it.evidence_rules(), ["l_orderkey", "l_linenumber", "l_partkey"])


@query(_rules_sql(
    "select *, o_orderstatus <> 'P' as live, case when o_orderkey % 7 <> 0 then o_totalprice end as base, case when o_orderkey % 3 = 0 then o_custkey * 100.0 end as low, o_orderkey % 4 > 0 as backed from orders",
    "o_orderkey",
    {
        "available_has_value": "not live or (base is not null and backed)",
        "unavailable_has_no_value": "live or (base is null and low is null)",
        "unavailable_has_reason": "live or o_custkey % 2 = 0",
        "ordered": "not live or base is null or low is null or low <= base",
    },
))
def availability_contract(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", "AVAILABLE").otherwise("NOT_DISCLOSED").alias("availability"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("base"), F.when(k % 3 == 0, F.col("o_custkey") * 100.0).alias("low"),
        F.lit(None).cast("double").alias("high"), F.lit("stated").alias("method"), F.when(k % 4 > 0, F.array(k)).otherwise(F.array().cast("array<long>")).alias("evidence_ids"), F.when(F.col("o_custkey") % 2 == 0, "silent").alias("reason"),
    )
    return it.check(rows, it.availability_rules(), ["o_orderkey"])


@query(_rules_sql(
    "select *, event_type = 'error' as yes, date '2024-01-10' as cutoff from events",
    "event_id",
    {"label_known": "event_type <> 'view'", "adjudicated": "user_id % 5 <> 0 and value < 40", "positive_has_source": "not yes or event_id % 6 <> 0", "positive_in_window": "not yes or (ts::date > cutoff and ts::date <= cutoff + 10)"},
))
def adjudication_contract(t):
    rows = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "positive").when(F.col("event_type") == "view", "maybe").otherwise("negative").alias("label"), F.when(F.col("user_id") % 5 != 0, "a").alias("adjudicator"), F.when(F.col("value") < 40, F.col("ts")).alias("adjudicated_at"),
        F.when(F.col("event_id") % 6 != 0, "s").alias("source"), F.to_date("ts").alias("event_date"), F.lit("2024-01-10").cast("date").alias("cutoff"), F.lit("2024-01-20").cast("date").alias("window_end"),
    )
    return it.check(rows, it.adjudication_rules(), ["event_id"])


@query("select l_linenumber as referring, l_partkey as ref, p_size as occasion from lineitem join part on p_partkey = l_partkey where p_size <> l_linenumber")
def crossed_references(t):
    refs = t.lineitem.select(F.col("l_linenumber").alias("occasion"), F.array("l_partkey").alias("refs"))
    known = t.part.select(F.col("p_partkey").alias("ref"), F.col("p_size").alias("occasion"))
    return it.crossed_references(refs, "refs", known, "ref", "occasion").withColumnRenamed("_o", "referring")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def keys_in_both(t):
    return sa.keys_in_both(t.customer, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select c_nationkey, c_mktsegment, count(*) as n from customer group by all having count(*) < 12")
def short_strata(t):
    return sa.short_strata(t.customer, ["c_nationkey", "c_mktsegment"], 12)


@query("""with n as (select o_custkey, 'status' as dimension, o_orderstatus as v, count(*) as n from orders group by all union all select o_custkey, 'priority', o_orderpriority, count(*) from orders group by all)
select o_custkey, dimension, string_agg(v || '=' || n, ',' order by v) as counts from n group by 1, 2""")
def mix_maps(t):
    long = t.orders.select("o_custkey", F.explode(F.array(F.struct(F.lit("status").alias("dimension"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("dimension"), F.col("o_orderpriority").alias("value")))).alias("d")).select("o_custkey", "d.*")
    maps = lo.as_maps(long.groupBy("o_custkey", "dimension", "value").agg(F.count(F.lit(1)).alias("n")), ["o_custkey"])
    pairs = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("o_custkey", "dimension", F.array_join(pairs, ",").alias("counts"))


@query("""with r as (select l_partkey as company_id, l_returnflag as target, l_shipdate::date as window_start, max_by(l_quantity, l_orderkey * 10 + l_linenumber) as outcome, max(l_orderkey * 10 + l_linenumber) as resolved_at from lineitem where l_linestatus = 'F' group by 1, 2, 3)
select l_orderkey, l_linenumber, r.outcome, r.resolved_at from lineitem join r on company_id = l_partkey and target = l_returnflag and window_start = l_shipdate::date""")
def resolve_outcomes(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("company_id"), F.col("l_returnflag").alias("target"), F.col("l_shipdate").alias("cutoff"))
    outcomes = t.lineitem.select(F.col("l_partkey").alias("company_id"), F.col("l_returnflag").alias("target"), F.to_date("l_shipdate").alias("window_start"), F.when(F.col("l_linestatus") == "F", "resolved").otherwise("open").alias("status"), F.col("l_quantity").alias("outcome"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("resolved_at"))
    return pt.resolve_outcomes(rows, outcomes).select("l_orderkey", "l_linenumber", "outcome", "resolved_at")


@query("select c_custkey, c_name, c_nationkey from customer")
def blind_projection(t):
    return pt.blind(t.customer, ["c_custkey", "c_name", "c_nationkey"], ["c_acctbal", "c_mktsegment"])


@query("select l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.5 + (l_quantity - 25) / 14 * 0.8 - (l_discount - 0.05) / 0.03 * 0.4))), 9) as p from lineitem")
def standard_logistic(t):
    p = sc.standard_logistic(-0.5, {"l_quantity": (0.8, 25.0, 14.0), "l_discount": (-0.4, 0.05, 0.03)})
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(p, 9).alias("p"))


@query("select distinct user_id, sha256(event_type) as digest from events")
def ingest_once(t):
    rows = t.events.select("user_id", F.sha2("event_type", 256).alias("digest"), "ts")
    return lc.ingest(rows, ["user_id"], "digest", "ts").select("user_id", "digest")


@query("""with a as (select user_id, event_id, event_type as h from events where event_id % 4 = 0), s as (select user_id, max(event_id) as v, max_by(h, event_id) as h from a group by 1),
b as (select e.user_id, e.event_id, e.event_type as h, coalesce(lag(e.event_type) over (partition by e.user_id order by e.ts, e.event_type, e.event_id), s.h) as before, coalesce(s.v, 0) as v from events e left join s using (user_id) where e.event_id % 4 <> 0),
c as (select e.ts, b.* from b join events e using (event_id))
select user_id, event_id, h as digest, (v + row_number() over (partition by user_id order by ts, h, event_id))::integer as version from c where before is distinct from h""")
def append_versions(t):
    rows = t.events.select("user_id", "event_id", F.col("event_type").alias("digest"), "ts")
    store = rows.where("event_id % 4 = 0").withColumn("version", F.col("event_id").cast("int"))
    return lc.append_versions(store, rows.where("event_id % 4 <> 0"), ["user_id"], "digest", "ts").select("user_id", "event_id", "digest", "version")


@query("""with d as (select user_id as c_custkey, max_by(event_type, (ts, event_type)) as decision, max(ts) as latest from events group by 1)
select c_custkey, coalesce(decision, 'pending') as decision, epoch_us(latest) as us from customer left join d using (c_custkey)""")
def current_decisions(t):
    log = t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("decision"), F.col("ts").cast("timestamp").alias("decided_at"))
    return lc.current_decisions(t.customer.select("c_custkey"), log, "c_custkey").select("c_custkey", "decision", F.unix_micros("decided_at").alias("us"))
