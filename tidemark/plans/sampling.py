"""Sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sampling as sa
from tidemark.plans.registry import query


@query("select c_custkey, c_mktsegment, place from (select *, row_number() over (partition by c_mktsegment order by sha256('pilot|' || c_custkey), c_custkey)::integer as place from customer) where place <= 10")
def hash_sample(t):
    return sa.hash_stratified(t.customer, ["c_mktsegment"], ["c_custkey"], 10, "pilot").select("c_custkey", "c_mktsegment", "place")


@query("select source, doc_id, place from (select source, doc_id, row_number() over (partition by source order by sha256('cap|' || doc_id), doc_id)::integer as place from (select distinct source, doc_id from documents)) where place <= 9")
def hash_cap(t):
    return sa.hash_cap(t.documents, ["source"], ["doc_id"], 9, "cap").select("source", "doc_id", "place")


@query("with d as (select doc_id, lang, quality::varchar as label from documents join labels using (doc_id)), r as (select *, row_number() over (partition by lang, label order by doc_id)::integer as place from d) select lang, label, doc_id, place from r where place <= case label when '1' then 12 else 6 end")
def balanced_sample(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", F.col("quality").cast("string").alias("label"))
    return sa.balanced(d, "lang", "label", {"1": 12, "0": 6}, "doc_id")[0].select("lang", "label", "doc_id", "place")


@query("""with d as (select doc_id, source, (case when quality = 0 then 100 else 0 end + case when toxic = 1 then 60 else 0 end + case when n_chars > 4000 then 40 else 0 end) as score, n_chars from documents join labels using (doc_id)),
r as (select *, row_number() over (partition by source order by score desc, n_chars desc, doc_id)::integer as family_place from d)
select source, doc_id, family_place from r where family_place <= 6 order by (family_place <= 4) desc, score desc, n_chars desc, doc_id limit 36""")
def priority_slice(t):
    d = t.documents.join(t.labels, "doc_id").withColumn("score", F.when(F.col("quality") == 0, 100).otherwise(0) + F.when(F.col("toxic") == 1, 60).otherwise(0) + F.when(F.col("n_chars") > 4000, 40).otherwise(0))
    return sa.priority_slice(d, "source", [F.desc("score"), F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id", "family_place")


@query("""with c as (select c_custkey, unnest([{'cutoff': '2024-06-30', 'part': 'development'}, {'cutoff': '2024-12-31', 'part': 'validation'}, {'cutoff': '2025-06-30', 'part': 'holdout'}]) as s from customer)
select c_custkey, s.cutoff as cutoff, s.part as "partition" from c where not (s.cutoff = '2024-12-31' and c_custkey in (select o_custkey from orders where o_orderstatus = 'P'))""")
def assign_partitions(t):
    used = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sa.assign_partitions(t.customer, [("2024-06-30", "development"), ("2024-12-31", "validation"), ("2025-06-30", "holdout")], "c_custkey", used, "2024-12-31")


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def keys_only_in(t):
    return sa.keys_only_in(t.customer, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select o_custkey, o_orderkey, place from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::integer as place from orders) where place <= 3")
def per_group_cap(t):
    return sa.per_group_cap(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "place")
