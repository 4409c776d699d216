"""Integrity queries on lineitem, orders, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import integrity as it
from tidemark.operators import joins as jo
from tidemark.plans.registry import query


@query("select l_orderkey, ref from (select l_orderkey, unnest([l_partkey, l_suppkey + 1950]) as ref from lineitem) where ref not in (select p_partkey from part)")
def reference_closure(t):
    refs = t.lineitem.select("l_orderkey", F.array(F.col("l_partkey"), F.col("l_suppkey") + 1950).alias("refs"))
    return it.open_references(refs, "refs", t.part.select(F.col("p_partkey").alias("ref")), "ref", ["l_orderkey"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def unique_check(t):
    return it.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_linenumber, l_shipdate, o_orderdate from lineitem join orders on l_orderkey = o_orderkey where l_shipdate > o_orderdate")
def leakage_check(t):
    o = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return it.leaks(t.lineitem, o, "l_orderkey", "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query("""select l_orderkey, l_linenumber, unnest(list_filter([case when coalesce(l_discount between 0 and 0.05, false) then null else 'discount' end, case when coalesce(l_tax <= 0.06, false) then null else 'tax' end, case when coalesce(l_returnflag in ('A', 'N'), false) then null else 'flag' end], lambda x: x is not null)) as rule from lineitem""")
def constraint_check(t):
    rules = {"discount": F.col("l_discount").between(0, 0.05), "tax": F.col("l_tax") <= 0.06, "flag": F.col("l_returnflag").isin("A", "N")}
    return it.check(t.lineitem, rules, ["l_orderkey", "l_linenumber"])


@query("""with g as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as parts, list(distinct l_returnflag order by l_returnflag) as flags from lineitem group by 1), i as (select *, unnest(range(greatest(len(parts), len(flags)))) as place from g)
select l_orderkey, place::integer as place, parts[place + 1] as parts, flags[place + 1] as flags from i""")
def provenance_fanout(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return it.provenance(g, "l_orderkey", ["parts", "flags"])


@query("""with l as (select l_orderkey, l_linenumber, unnest([{'feature': 'l_discount', 'value': l_discount, 'contribution': l_discount * 2.0::double}, {'feature': 'l_tax', 'value': l_tax, 'contribution': l_tax * (-1.5)::double}]) as p from lineitem)
select l_orderkey, l_linenumber, p.feature as feature, p.value as value, round(p.contribution, 9) + 0.0 as contribution, case when p.contribution > 0 then 'raises' when p.contribution < 0 then 'lowers' else 'none' end as direction from l""")
def unpivot_contributions(t):
    return it.diagnostics(t.lineitem, ["l_orderkey", "l_linenumber"], {"l_discount": 2.0, "l_tax": -1.5}).withColumn("contribution", F.round("contribution", 9) + 0.0)


@query("""with a as (select conv_id, count(*) as n, min_by(role, turn) as role, min_by(text, turn) as span from conversations where conv_id % 5 <> 0 group by 1), f as (select distinct conv_id, text as context from conversations where turn = 0 and conv_id % 7 <> 0),
j as (select coalesce(a.conv_id, f.conv_id) as conv_id, a.n, f.context, a.role, a.span, f.conv_id is not null as known from a full join f on a.conv_id = f.conv_id)
select conv_id, unnest(list_filter([case when n is null then 'missing' end, case when not known then 'unexpected' end, case when n is not null and coalesce(role <> 'user', true) then 'domain:role' end,
 case when span is not null and context is not null and not contains(lower(trim(regexp_replace(context, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(span, '\\s+', ' ', 'g')))) then 'span' end], lambda x: x is not null)) as problem from j""")
def membership_check(t):
    c = t.conversations
    a = c.where("conv_id % 5 <> 0").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.min_by("text", "turn").alias("span"))
    f = c.where("turn = 0 and conv_id % 7 <> 0").select("conv_id", F.col("text").alias("context")).distinct()
    return it.membership(a, f, "conv_id", {"role": ["user"]})


@query("""with d as (select distinct lower(trim(s)) as value from (select unnest(string_split_regex(text, '[.!?][ \\n]+')) as s from documents)), b as (select distinct lower(trim(s)) as value from (select unnest(string_split_regex(text, '[.!?][ \\n]+')) as s from benchmark))
select 'sentence' as field, value from d where length(value) >= 40 and value in (select value from b)""")
def contamination(t):
    sentences = lambda d: d.select(F.explode(F.split("text", "[.!?][ \\n]+")).alias("sentence")).where(F.length(F.trim("sentence")) >= 40)
    return jo.contamination(sentences(t.documents), [sentences(t.benchmark)], ["sentence"])


@query("select sha256('{\"c_mktsegment\":' || coalesce('\"' || c_mktsegment || '\"', 'null') || ',\"c_name\":' || coalesce('\"' || c_name || '\"', 'null') || '}') as h, c_custkey from customer")
def row_hashes(t):
    from tidemark.functions.text import row_hash

    return t.customer.select(row_hash(["c_name", "c_mktsegment"]).alias("h"), "c_custkey")


@query("select o_custkey, sha256('[' || string_agg('\"' || o_orderkey || '\"', ',' order by o_orderkey::varchar) || ']') as evidence_hash from orders group by 1")
def snapshot_hashes(t):
    s = t.orders.select("o_custkey").distinct()
    return it.prediction_records(s, t.orders.select("o_custkey", F.col("o_orderkey").alias("evidence_id")), "o_custkey")


@query("with n as (select c_custkey, c_nationkey % 3 as v, c_custkey < 1000 as old from customer) select c_custkey from n where not old")
def register_new(t):
    n = t.customer.select("c_custkey", (F.col("c_nationkey") % 3).alias("v"))
    new, _ = it.register(n.where("c_custkey < 1000"), n, ["c_custkey"], ["v"])
    return new.select("c_custkey")
