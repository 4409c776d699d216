"""Queries on joins of predictions, extracted values, job classes, texts and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse as pa
from tidemark.functions import text as tx
from tidemark.operators import evaluation as ev
from tidemark.operators import extraction as ex
from tidemark.operators import figures as fg
from tidemark.operators import integrity as it
from tidemark.operators import joins as jo
from tidemark.operators import ladders as la
from tidemark.operators import longitudinal as lo
from tidemark.operators import pointintime as pt
from tidemark.operators import sampling as sa
from tidemark.plans.registry import query
from tidemark.sources import postings as po
from tidemark.sources import tables as st
from tidemark.streaming import lifecycle as lc

STATUS = {"F": "accepted", "P": "corrected", "O": "pending"}


def mapped(column: str, table: dict[str, str]):
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(column))


def picked(values: list[str], key: str):
    """One of the values by the key, and its SQL."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def picked_sql(values: list[str], key: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{key} % {len(values)} + 1]"


@query("select o_orderkey from orders where o_orderdate <= date '1996-06-30' and o_orderstatus in ('F', 'P')")
def eligible_observations(t):
    o = t.orders.select("o_orderkey", F.col("o_orderdate").alias("available_at"), mapped("o_orderstatus", STATUS).alias("status"))
    return pt.eligible_observations(o, "1996-06-30").select("o_orderkey")


@query("""with o as (select o_orderkey, o_orderdate::date as d, o_orderkey % 17 = 0 as forced, o_orderdate::date + (o_orderkey % 500)::integer as a, o_orderdate::date + (o_orderkey % 300)::integer as f from orders),
p as (select *, a <= d + 200 and abs(year(a) - year(d)) <= 1 as fits, f <= d + 200 as made from o)
select o_orderkey, case when forced then d when fits then a when made then f end as available_on, case when forced then 'override' when fits then 'approval_date' when made then 'file_creation' else 'none' end as basis from p""")
def availability_dates(t):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    plus = lambda n: F.date_add(d, n.cast("int"))
    o = t.orders.select("o_orderkey", F.when(k % 17 == 0, d).alias("override_on"), F.array(plus(k % 500), plus(F.lit(900))).alias("approval_dates"), F.year(d).alias("report_year"), plus(F.lit(200)).alias("cutoff"), plus(k % 300).alias("created_on"))
    return pt.availability_date(o).select("o_orderkey", "available_on", "basis")


@query("select prediction_id, evidence_id, p_brand, (row_number() over (partition by prediction_id order by abs(c) desc, evidence_id))::integer as place from (select l_orderkey as prediction_id, l_partkey as evidence_id, l_discount - 0.05 as c, p_brand from lineitem join part on p_partkey = l_partkey)")
def prediction_contributions(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("prediction_id"), F.col("l_partkey").alias("evidence_id"), (F.col("l_discount") - 0.05).alias("contribution"))
    return pt.evidence_contributions(links, t.part.select(F.col("p_partkey").alias("evidence_id"), "p_brand")).select("prediction_id", "evidence_id", "p_brand", "place")


@query("select c_custkey, n from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey")
def customers_with_counts(t):
    n = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return pt.left_on(t.customer.select("c_custkey"), n, ["c_custkey"])


@query("""with e as (select event_id % 300 as doc_id, string_agg(event_type, chr(10) order by event_id) as evidence_text from events group by 1),
p as (select doc_id, date '2024-01-01' + (doc_id % 50)::integer as cutoff from documents)
select p.doc_id, case quality when 1 then 'yes' else 'no' end as label, evidence_text, case when date '2024-01-20' > cutoff then date '2024-01-20' - cutoff end::integer as lead_days from p join labels using (doc_id) left join e using (doc_id) where quality = 1 or doc_id % 2 = 1""")
def labelled_predictions(t):
    p = t.documents.select("doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 50).cast("int")).alias("cutoff"))
    y = t.labels.select("doc_id", F.when(F.col("quality") == 1, "yes").when(F.col("doc_id") % 2 == 1, "no").otherwise("uncertain").alias("label"), F.lit("2024-01-20").cast("date").alias("event_date"))
    e = t.events.select((F.col("event_id") % 300).alias("doc_id"), F.col("event_id").alias("evidence_id"), F.col("event_type").alias("text"))
    return pt.predictions_with_labels(p, y, e, "doc_id").select("doc_id", "label", "evidence_text", "lead_days")


@query("""with c as (select s_suppkey as id, 'I' || s_suppkey as code, case when s_suppkey % 10 < 2 then 'Twin Group' else s_name end as name from supplier),
d as (select s_suppkey, case when s_suppkey % 4 = 0 then s_suppkey when s_suppkey % 8 = 5 then -1 end as explicit_id, case when s_suppkey % 4 = 1 then 'I' || s_suppkey when s_suppkey % 4 = 2 then 'none' end as code, case when s_suppkey % 9 = 3 then 'nobody' else name || ' Ltd' end as name from supplier join c on id = s_suppkey),
k as (select *, array_to_string(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w not in ('plc', 'limited', 'ltd', 'holdings', 'group', 'the', '')), ' ') as k from c),
n as (select k, count(distinct id) as n, min(id) as id from k group by 1),
e as (select d.*, array_to_string(list_filter(string_split(trim(regexp_replace(lower(d.name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w not in ('plc', 'limited', 'ltd', 'holdings', 'group', 'the', '')), ' ') as k from d)
select s_suppkey, coalesce(a.id, b.id, case when n.n = 1 then n.id end) as company_id, case when a.id is not null then 'explicit' when b.id is not null then 'identifier' when n.n = 1 then 'name' when n.n > 1 then 'ambiguous' else 'unknown' end as identity
from e left join c a on a.id = e.explicit_id left join c b on b.code = e.code left join n on n.k = e.k""")
def identity_resolution(t):
    k = F.col("s_suppkey")
    name = F.when(k % 10 < 2, "Twin Group").otherwise(F.col("s_name"))
    c = t.supplier.select(k.alias("company_id"), F.concat(F.lit("I"), k.cast("string")).alias("identifier"), name.alias("name"))
    d = t.supplier.select("s_suppkey", F.when(k % 4 == 0, k).when(k % 8 == 5, -1).alias("explicit_id"), F.when(k % 4 == 1, F.concat(F.lit("I"), k.cast("string"))).when(k % 4 == 2, "none").alias("identifier"), F.when(k % 9 == 3, "nobody").otherwise(F.concat(name, F.lit(" Ltd"))).alias("name"))
    return jo.resolve_identity(d, c).select("s_suppkey", "company_id", "identity")


@query("""with p as (select l_orderkey as k, l_quantity as v, l_linenumber as n, l_linenumber * 1000000 + l_partkey as o, l_returnflag <> 'R' as sourced from lineitem where l_linenumber <> 2 or l_orderkey % 3 > 0), f as (select k, min_by(v, o) as v from p where k % 5 <> 0 or n > 2 group by 1), q as (select * from p where k % 5 <> 0 or n > 2),
j as (select o_orderkey % 50 as g, f.v from orders left join f on f.k = o_orderkey)
select (select count(*) from j) as gold, (select count(v) from j) as found, round((select count(*) filter (v = g) / nullif(count(v), 0)::double from j), 9) as accuracy, round((select count(*) filter (v = g) / count(*)::double from j), 9) as recall,
round((select 1 - count(v) / count(*)::double from j), 9) as missing_rate, round((select 1 - count(distinct k) / count(*)::double from q), 9) as duplicate_rate, round((select count(*) filter (sourced) / count(*)::double from q), 9) as provenance_rate""")
def extraction_quality(t):
    p = t.lineitem.where("(l_linenumber <> 2 or l_orderkey % 3 > 0) and (l_orderkey % 5 <> 0 or l_linenumber > 2)").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("double").alias("value"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ordinal"), F.when(F.col("l_returnflag") != "R", "h").alias("source_hash"))
    out = ev.extraction_quality(p, t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 50).cast("double").alias("value")), "k")
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "recall", "missing_rate", "duplicate_rate", "provenance_rate")})


@query("""select doc_id, case when doc_id % 4 = 0 then 'x' else lang end is not distinct from lang and lower(trim(regexp_replace(case when doc_id % 5 = 0 then 'other' else source || '  A' end, '\\s+', ' ', 'g'))) is not distinct from lower(source || ' a') as agree from documents where n_chars > 500 and doc_id % 3 <> 0""")
def material_agreement(t):
    d = t.documents
    a = d.select("doc_id", F.when(F.col("n_chars") > 500, "YES").otherwise("NO").alias("label"), "lang", F.concat("source", F.lit(" a")).alias("text"))
    b = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, "YES").otherwise("NO").alias("label"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.concat(F.lit(" "), F.upper("source"), F.lit("  A"))).alias("text"))
    return ev.material_agreement(a, b, "doc_id", ["lang"], ["text"])


@query("""with l as (select event_type, user_id, min(ts)::date as f, max(ts)::date as s, user_id % 7 = 0 as closed, user_id % 3 as misses, user_id % 4 as reopened from events group by all), m as (select *, max(s) over (partition by event_type) as l from l)
select event_type, count(*) filter (not closed) as open, count(*) filter (f = l) as new, count(*) filter (not closed and misses > 0) as absent, count(*) filter (closed) as closed, sum(reopened)::bigint as reopened from m group by 1""")
def profile_counts(t):
    u = F.col("user_id")
    life = t.events.groupBy("event_type", "user_id").agg(F.to_date(F.min("ts")).alias("first_seen"), F.to_date(F.max("ts")).alias("last_seen")).withColumns({"status": F.when(u % 7 == 0, "closed").otherwise("open"), "misses": u % 3, "reopened": u % 4})
    return lo.profile_counts(life, ["event_type"])


@query("""with g as (select p_partkey as k, p_brand as f, p_size % 3 as s from part), j as (select g.k, g.f, g.s, h.k as hk, case when h.k % 5 = 0 then 'x' else h.f end as hf, case when h.k % 7 = 0 then 9 else h.s end as hs from g left join g h on h.k = g.k and h.k % 4 <> 0)
select count(*) as gold, count(hk) as found, round(avg((f = hf)::int) filter (hk is not null), 9) as function_rate, round(avg((s = hs)::int) filter (hk is not null), 9) as seniority_rate, round(avg((hk % 11 <> 0)::int) filter (hk is not null), 9) as location_rate from j""")
def job_accuracy(t):
    k = F.col("p_partkey")
    gold = t.part.select("p_partkey", F.col("p_brand").alias("function"), (F.col("p_size") % 3).alias("seniority"), F.lit("New  York").alias("location"))
    found = gold.where("p_partkey % 4 <> 0").withColumns({"function": F.when(k % 5 == 0, "x").otherwise(F.col("function")), "seniority": F.when(k % 7 == 0, 9).otherwise(F.col("seniority")), "location": F.when(k % 11 == 0, "Rome").otherwise(" New York ")})
    return ev.job_accuracy(gold, found, "p_partkey").withColumns({c: F.round(c, 9) for c in ("function_rate", "seniority_rate", "location_rate")})


@query("""with x as (select distinct s_nationkey as c, s_suppkey % 5 as e from supplier), j as (select n_nationkey as c, (x.c is not null) = (n_nationkey % 2 = 0) as ok from nation left join x on x.c = n_nationkey and x.e = n_regionkey)
select count(*) as cases, round(avg(ok::int), 9) as rate, array_to_string(list_sort(list(c) filter (not ok)), ',') as failing from j""")
def expectation_accuracy(t):
    cases = t.nation.select(F.col("n_nationkey").cast("long").alias("case_id"), F.col("n_regionkey").cast("string").alias("expected_type"), (F.col("n_nationkey") % 2 == 0).alias("expects"))
    got = t.supplier.select(F.col("s_nationkey").cast("long").alias("case_id"), (F.col("s_suppkey") % 5).cast("string").alias("event_type"))
    out = ev.expectation_accuracy(cases, got)
    return out.select("cases", F.round("rate", 9).alias("rate"), F.array_join(F.col("failing").cast("array<string>"), ",").alias("failing"))


@query("""with f as (select o_custkey as c, year(o_orderdate) as y, o_orderpriority as metric, round(sum(o_totalprice), 2) as v from orders group by all), e as (select b.c, b.metric, a.v as p, b.v as q from f b left join f a on a.c = b.c and a.metric = b.metric and a.y = 1995 where b.y = 1996)
select metric, count(*) as expected, count(*) filter (p <> 0 and c % 3 <> 0) as right from e group by 1""")
def longitudinal_accuracy(t):
    y = F.year("o_orderdate").cast("string")
    f = t.orders.groupBy(F.col("o_custkey").alias("c"), y.alias("y"), F.col("o_orderpriority").alias("metric")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    facts = f.select(F.concat_ws("-", F.col("c").cast("string"), "y").alias("document"), "metric", "value", F.lit("USD").alias("currency"))
    at = lambda year: f.where(F.col("y") == year).select("c", "metric", F.col("value").alias(f"v{year}"))
    e = at("1996").join(at("1995"), ["c", "metric"], "left")
    change = F.when(F.col("c") % 3 == 0, 1e9).otherwise(F.round((F.col("v1996") - F.col("v1995")) / F.abs("v1995") * 100, 3))
    name = lambda year: F.concat(F.col("c").cast("string"), F.lit(f"-{year}"))
    return lo.longitudinal_accuracy(e.select(name(1995).alias("prior_document"), name(1996).alias("current_document"), "metric", change.alias("expected_change")), facts)


@query("select n_nationkey, n_name, coalesce((select string_agg(s_suppkey::varchar || ':' || s_name, ',' order by s_suppkey) from supplier where s_nationkey = n_nationkey), '') as suppliers from nation")
def nested_suppliers(t):
    s = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    out = st.nested(t.nation.select("n_nationkey", "n_name"), "n_nationkey", {"suppliers": (s, ["s_suppkey", "s_name"])})
    return out.select("n_nationkey", "n_name", F.array_join(F.transform("suppliers", lambda x: F.concat_ws(":", x["s_suppkey"].cast("string"), x["s_name"])), ",").alias("suppliers"))


@query("select c_custkey, n, case when n is null then 'LEGACY_SUMMARY_ONLY' else 'REDERIVED' end as origin from customer left join (select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) on o_custkey = c_custkey")
def backfilled_snapshots(t):
    d = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return st.backfill(t.customer.select("c_custkey"), d, ["c_custkey"], ["n"]).select("c_custkey", "n", "origin")


TITLES = ["Operations Director", "Data Lead", "Head of Purchasing", "Change Manager", "Treasury Accountant", "Factory Machinist", "Baker", "VP Machine Learning", "Plant Operator"]
CASES = "case when regexp_matches(x, 'operations?|plant|production|warehouse|quality') then 'operations' when regexp_matches(x, 'procurement|purchasing|sourcing|buyer') then 'procurement' when regexp_matches(x, 'transformation|change|programme|program manager') then 'transformation' when regexp_matches(x, 'finance|financial|accountant|treasury') then 'finance' when regexp_matches(x, '\\bai\\b|data|machine learning|analytics') then 'ai_data' when regexp_matches(x, 'manufactur|factory|machinist|engineering') then 'manufacturing' else 'other' end"
RANKS = "case when regexp_matches(x, 'chief|director|vice president|\\bvp\\b|head of') then 'senior' when regexp_matches(x, 'manager|lead') then 'manager' else 'individual_contributor' end"


@query(f"with x as (select p_partkey, p_brand, lower({picked_sql(TITLES, 'p_partkey')}) as x, row_number() over (partition by p_brand order by p_partkey) as r from part) select p_partkey, p_brand, r::integer as place, {CASES} as function, {RANKS} as seniority from x where r <= 10")
def gold_sample(t):
    sample, _ = st.gold_sample(t.part.select("p_partkey", "p_brand", picked(TITLES, "p_partkey").alias("title")), "p_brand", ["p_partkey"])
    return sample.select("p_partkey", "p_brand", "place", "function", "seniority")


DEPARTMENTS = ["Quality", "Sourcing", None, "Kitchen", "Analytics"]
DEPARTMENT = "([" + ", ".join("null" if d is None else f"'{d}'" for d in DEPARTMENTS) + "])[p_size % 5 + 1]"


@query(f"with x as (select p_partkey, lower(concat_ws(' ', {picked_sql(TITLES, 'p_partkey')}, {DEPARTMENT})) as x from part) select p_partkey, {CASES} as function from x")
def department_functions(t):
    return t.part.select("p_partkey", pa.infer_function(picked(TITLES, "p_partkey"), picked(DEPARTMENTS, "p_size")).alias("function"))


STACKS = ["Python and SQL Developer", "SAP consultant", "Cloud engineer AWS", "Java on Kubernetes", "Cook"]
NAMED = {"AWS": "contains(x, 'aws')", "Java": "contains(x, 'java')", "Kubernetes": "contains(x, 'kubernetes')", "Python": "contains(x, 'python')", "SAP": "contains(x, ' sap') or contains(x, 'sap ')", "SQL": "contains(x, ' sql') or contains(x, 'sql ')"}
NAMES = "[" + ", ".join(f"case when {c} then '{k}' end" for k, c in NAMED.items()) + "]"


@query(f"with x as (select p_partkey, ' ' || lower({picked_sql(STACKS, 'p_partkey')}) || ' ' as x from part), y as (select p_partkey, list_filter({NAMES}, lambda v: v is not null) as n from x) select p_partkey, array_to_string(n, ',') as names, array_to_string(list_filter([case when list_has_any(n, ['Python', 'Java', 'SQL']) then 'software_data_languages' end, case when list_has_any(n, ['AWS', 'Kubernetes']) then 'cloud_platforms' end, case when list_contains(n, 'SAP') then 'enterprise_applications' end], lambda v: v is not null), ',') as families from y")
def technology_names(t):
    f = pa.technologies(picked(STACKS, "p_partkey"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", f.alias("f")).select("p_partkey", F.array_join("f.names", ",").alias("names"), F.array_join("f.families", ",").alias("families"))


PLACES = ["New  York", "london, united kingdom", "Paris – Nord", " Rome "]


@query(f"with x as (select p_partkey, trim(regexp_replace(regexp_replace({picked_sql(PLACES, 'p_partkey')}, '[–—]', '-', 'g'), '\\s+', ' ', 'g')) as x from part) select p_partkey, case lower(x) when 'new york' then 'New York, NY' when 'london, united kingdom' then 'London, UK' else x end as place from x")
def normal_locations(t):
    return t.part.select("p_partkey", pa.normal_location(picked(PLACES, "p_partkey"), {"new york": "New York, NY", "london, united kingdom": "London, UK"}).alias("place"))


CHANGES = ["Capacity was reduced during the year.", "The company opened a new site.", "Pricing pressure increased.", "Nothing of note.", "Principal risks are told below", "See basis of preparation", "The directors met", "table\nof figures", "Legal proceedings are closed"]


@query(f"""with x as (select p_partkey, lower({picked_sql(CHANGES, 'p_partkey')}) as x from part), y as (select *, regexp_matches(x, '\\b(?:increase[ds]?|grew|growth|improv(?:e|ed|ement)|accelerat(?:e|ed|ion)|expand(?:ed|ing|sion)|open(?:ed|ing))\\b') as u, regexp_matches(x, '\\b(?:decrease[ds]?|declin(?:e|ed)|deteriorat(?:e|ed|ion)|contract(?:ed|ion)|reduc(?:e|ed|tion)|pressure|clos(?:e|ed|ure))\\b') as d from x)
select p_partkey, case when u and d then 'mixed' when u then 'increase_or_improvement' when d then 'decrease_or_deterioration' else 'not_directional_or_unknown' end as polarity, case when regexp_matches(x, '\\b(directors?|officers?|biograph)\\b') then 'biography' when regexp_matches(x, '\\b(accounting polic|basis of preparation|definitions?)\\b') then 'accounting_definition' when regexp_matches(x, '\\b(legal proceedings?|litigation)\\b') then 'legal' when regexp_matches(x, '\\b(risk factors?|principal risks?)\\b') then 'risk' when regexp_matches(x, '\\b(table)\\b') and contains(x, chr(10)) then 'table_or_fragment' else 'body_narrative' end as zone from y""")
def polarity_and_zone(t):
    s = picked(CHANGES, "p_partkey")
    return t.part.select("p_partkey", tx.polarity(s).alias("polarity"), tx.source_zone(F.lit(None).cast("string"), s).alias("zone"))


@query("""select k, name, start_on, value from (select l_orderkey as k, l_returnflag as name, l_shipdate::date::varchar as start_on, l_quantity::double as value, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber desc, l_shipdate::date::varchar, l_quantity) as r from lineitem) where r = 1""")
def primary_facts(t):
    start = F.to_date("l_shipdate")
    f = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("name"), start.cast("string").alias("start_on"), F.date_add(start, F.col("l_linenumber").cast("int")).cast("string").alias("end_on"), F.col("l_quantity").cast("double").alias("value"))
    return fg.primary_facts(f, "k", "name").select("k", "name", "start_on", "value")


@query("""select o_orderkey, case when o_orderpriority = '1-URGENT' then abs(500 - o_orderkey % 1000) else 500 - o_orderkey % 1000 end::double as value, 'o-' || substr(sha256(o_orderpriority), 1, 12) as id, case when o_orderkey % 3 = 0 then -(o_orderkey % 1000) when o_orderkey % 3 = 1 then -(o_orderkey % 1000) else o_orderkey % 1000 end::double as tagged,
o_orderkey % 3 <> 2 as matches, o_orderdate::timestamp + interval 90 minute as at from orders""")
def fact_values(t):
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 1000).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("(<b>"), n, F.lit("</b>)"))).otherwise(n)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    period = F.when(k % 3 == 0, F.concat(F.lit(" FY"), F.date_format("o_orderdate", "yyyy"))).when(k % 3 == 1, F.concat(F.lit("to "), day)).otherwise("2001 or so")
    return t.orders.select("o_orderkey", ex.canonical_value(F.when(F.col("o_orderpriority") == "1-URGENT", "capex").otherwise("revenue"), (500 - k % 1000).cast("double")).alias("value"), tx.stable_id("o-", F.col("o_orderpriority")).alias("id"), pa.ixbrl_number(text, F.when(k % 3 == 1, "-").otherwise("")).alias("tagged"), pa.period_matches(period, F.col("o_orderdate")).alias("matches"), pa.iso_timestamp(F.concat(day, F.lit("T01:30:00Z"))).cast("timestamp_ntz").alias("at"))


@query("""with a as (select page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as x from pages) select page_id, nullif(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '') as text from a""")
def stripped_pages(t):
    return t.pages.select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("select doc_id, regexp_replace(regexp_replace(text, '(?i)license version', '[redacted]', 'g'), '(?i)license', '[redacted]', 'g') as text from documents")
def redacted_documents(t):
    return t.documents.select("doc_id", tx.redact(F.col("text"), ["license", "license version"]).alias("text"))


@query("""with a as (select doc_id, text, length(text) as n, greatest(instr(text, lang), 1) + length(lang) / 2.0 - 200 as low from documents) select doc_id, case when n <= 400 then text else substr(text, trunc(greatest(1, least(low, n - 399)))::integer, 400) end as context from a""")
def truncated_contexts(t):
    return t.documents.select("doc_id", tx.truncate_context(F.col("text"), F.col("lang"), 400).alias("context"))


@query("select c_custkey, sha256('seed|' || c_custkey) as turn from customer")
def shuffled_customers(t):
    return sa.shuffled(t.customer.select("c_custkey"), "seed", "c_custkey").withColumn("turn", sa.turn("seed", "c_custkey"))


@query("select c_custkey::varchar as id, c_name as text, case c_mktsegment when 'BUILDING' then 'build' else c_mktsegment end as label from customer union all select s_suppkey::varchar, s_name, null from supplier")
def unioned_sources(t):
    return sa.union_mapped([(t.customer, {"id": "c_custkey", "text": "c_name", "label": "c_mktsegment"}, {"BUILDING": "build"}), (t.supplier, {"id": "s_suppkey", "text": "s_name"}, {})], ["id", "text", "label"])


@query("select doc_id::varchar as case_id, source as text, case quality when 1 then 'supported' else 'no' end as label, 'labelled' as origin from documents join labels using (doc_id) where quality = 0 union all select item_id::varchar, 'benchmark', 'written', 'written' from benchmark")
def regression_cases(t):
    d = t.documents.select(F.col("doc_id").alias("row_index"), F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("text"))
    y = t.labels.select(F.col("doc_id").alias("row_index"), F.when(F.col("quality") == 1, "supported").otherwise("no").alias("label"))
    return sa.regression_cases(d, y, t.benchmark.select(F.col("item_id").cast("string").alias("case_id"), F.lit("benchmark").alias("text"), F.lit("written").alias("label")))


@query("""with d as (select o_custkey as ticker, o_orderstatus = 'F' as annual, o_orderdate::date as published, o_orderkey as document from orders), k as (select ticker, row_number() over (order by ticker) as position from (select distinct ticker from d order by ticker limit 15)),
r as (select d.*, position, row_number() over (partition by d.ticker, annual order by published, document) as u, row_number() over (partition by d.ticker, annual order by published desc, document desc) as w, bool_or(not annual) over (partition by d.ticker) as o from d join k using (ticker))
select ticker, document, case when position % 2 = 1 then 'A' else 'B' end as workflow from r where u = 1 or (annual and not o and w = 1)""")
def paired_documents(t):
    d = t.orders.select(F.col("o_custkey").alias("ticker"), (F.col("o_orderstatus") == "F").alias("annual"), F.to_date("o_orderdate").alias("published"), F.col("o_orderkey").alias("document"))
    return sa.paired_documents(d).select("ticker", "document", "workflow")


@query("""with s as (select user_id, min(ts) as first_seen, max(ts) as last_seen, case when user_id % 4 = 0 then timestamp '2024-01-10' end as closed_at from events where user_id % 5 <> 0 group by 1), p as (select distinct user_id from events where user_id % 3 = 0)
select coalesce(s.user_id, p.user_id) as user_id, coalesce(first_seen, timestamp '2024-03-01') as first_seen, case when p.user_id is not null then timestamp '2024-03-01' else last_seen end as last_seen, case when p.user_id is not null then null else coalesce(closed_at, timestamp '2024-03-01') end as closed_at from s full join p on p.user_id = s.user_id""")
def presence_upserts(t):
    e = t.events
    s = e.where("user_id % 5 <> 0").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("first_seen"), F.max("ts").cast("timestamp").alias("last_seen")).withColumn("closed_at", F.when(F.col("user_id") % 4 == 0, F.lit("2024-01-10").cast("timestamp")))
    out = lc.presence_upsert(s, e.where("user_id % 3 = 0"), ["user_id"], "2024-03-01")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen", "closed_at")))


@query("select event_id, ts + to_days((event_id % 40)::integer) >= timestamp '2024-01-16' as late from events where ts < timestamp '2024-01-16'")
def late_evidence(t):
    e = t.events.select("event_id", F.col("ts").alias("available_at"), F.expr("ts + make_dt_interval(cast(event_id % 40 as int))").alias("collected_at"))
    return pt.admissible_late(e, "2024-01-15").select("event_id", "late")


@query("""with h as (select c_custkey, sha256('{"c_name":' || coalesce('"' || c_name || '"', 'null') || '}') as computed, sha256('{"c_name":"' || case when c_custkey % 9 = 0 then 'x' else c_name end || '"}') as stored from customer) select c_custkey, stored, computed from h where stored <> computed""")
def stale_hashes(t):
    stored = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "x").otherwise(F.col("c_name")).alias("c_name")).select("c_custkey", tx.row_hash(["c_name"]).alias("stored"))
    return it.stale_hashes(t.customer.join(stored, "c_custkey"), ["c_name"], "stored", ["c_custkey"])


@query("select distinct event_type || case when event_id % 3 = 0 then '_count' when event_id % 3 = 1 then '_change' else '_odd' end as feature_id from events where event_id % 3 = 2 or event_type not in (select distinct event_type from events where event_type <> 'error')")
def undefined_features(t):
    suffix = F.when(F.col("event_id") % 3 == 0, "_count").when(F.col("event_id") % 3 == 1, "_change").otherwise("_odd")
    return it.undefined_features(t.events.select(F.concat("event_type", suffix).alias("feature_id")), t.events.where("event_type <> 'error'").select("event_type").distinct(), ["count", "change"])


@query("""with d as (select o_orderkey, case when o_orderkey % 2 = 0 then 'prediction' else 'outcome' end as role, o_orderdate > date '1995-06-30' as late, o_orderkey % 5 = 0 as lost from orders)
select o_orderkey, case when role = 'prediction' and late then 'after_cutoff' when role = 'outcome' and not late then 'before_cutoff' else 'not_located' end as violation from d where (role = 'prediction' and late) or (role = 'outcome' and not late) or lost""")
def role_violations(t):
    k = F.col("o_orderkey")
    d = t.orders.select("o_orderkey", F.when(k % 2 == 0, "prediction").otherwise("outcome").alias("role"), F.to_date("o_orderdate").alias("available_at"), F.lit("1995-06-30").cast("date").alias("cutoff"), F.when(k % 5 != 0, "here").alias("location"))
    return it.role_violations(d).select("o_orderkey", "violation")


@query("select count(*) as rows, count(distinct c_nationkey) as reviewers, count(*) filter (c_custkey % 7 = 0 or c_custkey % 5 = 0) as unspanned from customer")
def annotation_freeze(t):
    k = F.col("c_custkey")
    d = t.customer.select(F.col("c_nationkey").alias("reviewer"), F.when(k % 7 != 0, F.col("c_name")).alias("span"), F.when(k % 5 != 0, F.lit("2024-01-01")).alias("annotated_at"))
    return it.freeze(d, ["reviewer", "span"]).select("rows", "reviewers", "unspanned")


URLS = ["https://boards.greenhouse.io/acme/jobs/1", "https://jobs.eu.lever.co/acme", "https://jobs.lever.co/acme/2", "https://acme.recruitee.com/o/x", "https://acme.wd3.myworkdayjobs.com/en", "https://acme.icims.com/jobs", "https://acme.teamtailor.com", "https://example.com/careers"]
HOSTS = "lower(regexp_extract(u, '^https?://([^/]+)', 1))"


@query(f"""with u as (select page_id, case when page_id % 9 = 8 then url else {picked_sql(URLS, 'page_id % 9')} end as u from pages), h as (select *, {HOSTS} as h, nullif(regexp_extract(u, '^https?://[^/]+/+([^/]+)', 1), '') as f from u)
select page_id, case when h = 'boards.greenhouse.io' then 'greenhouse' when h = 'jobs.eu.lever.co' then 'lever-eu' when h = 'jobs.lever.co' then 'lever' when ends_with(h, '.recruitee.com') then 'recruitee' when contains(h, 'myworkdayjobs.com') then 'workday' when ends_with(h, '.teamtailor.com') then 'teamtailor' when contains(h, 'icims.com') then 'icims' else 'unknown' end as provider,
case when h in ('boards.greenhouse.io', 'jobs.eu.lever.co', 'jobs.lever.co') then f when ends_with(h, '.recruitee.com') or contains(h, 'myworkdayjobs.com') or ends_with(h, '.teamtailor.com') then string_split(h, '.')[1] end as identifier, h in ('boards.greenhouse.io', 'jobs.eu.lever.co', 'jobs.lever.co') or ends_with(h, '.recruitee.com') as public_api from h""")
def job_boards(t):
    r = F.col("page_id") % 9
    p = t.pages.select("page_id", F.when(r == 8, F.col("url")).otherwise(F.element_at(F.array(*map(F.lit, URLS)), (F.least(r, F.lit(7)) + 1).cast("int"))).alias("u"))
    return p.select("page_id", po.detect_provider(F.col("u")).alias("p")).select("page_id", "p.provider", "p.identifier", "p.public_api")


@query("select o_orderkey, case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then 'accept' when o_orderstatus = 'O' or o_orderkey % 3 = 0 and o_orderkey % 2 = 1 then 'reject' else 'ambiguous' end as verdict from orders")
def combined_verdicts(t):
    k = F.col("o_orderkey")
    a = F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "reject").otherwise("ambiguous")
    b = F.when(k % 2 == 0, "accept").when(k % 3 == 0, "reject").otherwise("ambiguous")
    return t.orders.select("o_orderkey", la.combine(a, b).alias("verdict"))


SPANS = [
    "Restructuring costs (millions of dollars) 2024 24 2023 18", "Restructuring costs 2022 18 2021 25", "During 2024 we initiated a restructuring programme.", "1 Represents restructuring costs included in operating expenses for 2024.", "Restructuring charges for 2024 were $24 million.",
    "Our suppliers experienced labour shortages.", "We may experience supply chain disruption.", "We experienced supply chain disruption during the quarter.", "The company closed the Leeds site during 2025.", "Revenue increased 7% during the period.", "* Weak demand remains a concern.", "Charges related to the 2022 restructuring programme (were $18 million.",
]
EVENT_TYPES = ["restructuring", "restructuring", "restructuring", "restructuring", "restructuring", "labour_constraint", "supply_chain_constraint", "supply_chain_constraint", "site_closure", "growth_language", "demand_weakness", "restructuring"]
# What each of SPANS is by definition: structure, period, disposition, subject, fact, decision, family's disposition.
TRUTH = [
    ("table_row", "current_and_comparative", "rejected", "unknown", "ambiguous", "ambiguous", "reject"),
    ("table_row", "comparative_period", "rejected", "unknown", "ambiguous", "ambiguous", "reject"),
    ("narrative_sentence", "current_period", "accepted", "target_company", "actual_current", "accepted", "accept"),
    ("table_footnote", "current_period", "rejected", "unknown", "ambiguous", "ambiguous", "reject"),
    ("table_row", "current_period", "rejected", "unknown", "ambiguous", "ambiguous", "reject"),
    ("narrative_sentence", "unknown", "accepted", "supplier", "actual_current", "rejected", "reject"),
    ("narrative_sentence", "unknown", "accepted", "target_company", "hypothetical_risk", "rejected", "ambiguous"),
    ("narrative_sentence", "unknown", "accepted", "target_company", "actual_current", "accepted", "accept"),
    ("narrative_sentence", "future_period", "accepted", "target_company", "ambiguous", "accepted", "accept"),
    ("narrative_sentence", "unknown", "accepted", "target_company", "actual_current", "accepted", "accept"),
    ("list_bullet", "unknown", "accepted", "unknown", "ambiguous", "ambiguous", "reject"),
    ("malformed_unknown_fragment", "comparative_period", "rejected", "unknown", "ambiguous", "ambiguous", "reject"),
]
TRUTH_ROWS = ", ".join("(" + ", ".join([str(i), *(f"'{v}'" for v in row)]) + ")" for i, row in enumerate(TRUTH))


@query(f"""with v(i, structure_type, period_binding, disposition, subject_type, factual_status, decision, family_disposition) as (values {TRUTH_ROWS}) select event_id, v.* exclude (i) from events join v on event_id % {len(SPANS)} = i""")
def candidate_ladders(t):
    c = t.events.select("event_id", picked(SPANS, "event_id").alias("span"), F.lit("").alias("context"), picked(EVENT_TYPES, "event_id").alias("event_type"), F.lit("current").alias("event_status"), F.lit(2024).alias("report_year"))
    judged = la.acceptance(la.attribute_subject(la.table_disposition(c)))
    family = la.verify_family(judged.select("event_id", "span", "event_type", "subject_type")).select("event_id", F.col("disposition").alias("family_disposition"))
    return judged.select("event_id", "structure_type", "period_binding", "disposition", "subject_type", "factual_status", "decision").join(family, "event_id")
