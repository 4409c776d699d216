"""Evaluation queries: the score of a labelled document is n_chars / (n_chars + 1000)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.plans.registry import query

SCORED = "s as (select d.doc_id, d.source, d.lang, d.n_chars / (d.n_chars + 1000.0)::double as score, l.quality as label from documents d join labels l using (doc_id))"


def scored(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "source", "lang", (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score"), F.col("quality").alias("label"))


def rounded(df, *names, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in names})


RANKS = """
, g as (select {by} score, count(*) as n, sum(label)::bigint as pos from s group by {by} score)
, c as (select *, sum(n) over ({part} order by score desc) as cum_n, sum(pos) over ({part} order by score desc) as cum_pos,
    sum(n) over ({part}) as t_n, sum(pos) over ({part}) as t_pos from g)
, m as (select {by} t_n, t_pos, sum(pos * (score - 1) ** 2 + (n - pos) * score ** 2) / t_n as brier,
    sum(pos * cum_pos / cum_n::double) / nullif(t_pos, 0) as ap,
    sum(pos * ((t_n - t_pos - cum_n + cum_pos) + (n - pos) / 2.0)) / nullif(t_pos * (t_n - t_pos), 0) as auc,
    max(case when cum_n >= floor((t_n + 4) * 0.2) then score end) as edge
  from c group by {by} t_n, t_pos)
"""


@query(
    f"with {SCORED}"
    + RANKS.format(by="", part="")
    + """select t_n::bigint as n, t_pos::bigint as positives, round(brier, 9) as brier, round(ap, 9) as ap, round(auc, 9) as auc,
    round((select (cum_pos / cum_n::double) from c where score = edge) / (t_pos / t_n::double), 9) as lift from m"""
)
def binary_eval(t):
    return rounded(ev.rank_metrics(scored(t)).select("n", "positives", "brier", "ap", "auc", "lift"), "brier", "ap", "auc", "lift")


@query(
    f"with {SCORED}"
    + RANKS.format(by="source,", part="partition by source")
    + "select source, t_n::bigint as n, t_pos::bigint as positives, round(brier, 9) as brier, round(ap, 9) as ap, round(auc, 9) as auc from m"
)
def stratum_eval(t):
    return rounded(ev.rank_metrics(scored(t), by=["source"]).select("source", "n", "positives", "brier", "ap", "auc"), "brier", "ap", "auc")


def _bins(edges, keep):
    rows = ", ".join(f"({i}, {a!r}::double, {b!r}::double)" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    last = len(edges) - 2
    return f"""with {SCORED}, bins(bin, low, high) as (values {rows})
select b.bin::integer as bin, b.low, b.high, count(s.score) as n, round(coalesce(avg(s.score), 0.0), 9) as mean_score, round(coalesce(avg(s.label), 0.0), 9) as observed
from bins b {"left" if keep else ""} join s on s.score >= b.low and (s.score < b.high or (b.bin = {last} and s.score <= b.high)) group by all"""


EQUAL = [i / 10 for i in range(11)]
EDGES = [0.0, 0.05, 0.2, 0.5, 0.8, 0.97, 1.0]


@query(_bins(EQUAL, False))
def calibration_equal(t):
    return rounded(ev.calibration(scored(t), EQUAL, keep_empty=False), "mean_score", "observed")


@query(_bins(EDGES, True))
def calibration_edges(t):
    return rounded(ev.calibration(scored(t), EDGES, keep_empty=True), "mean_score", "observed")


@query(f"""with {SCORED}, c as (select score, sum(count(*)) over (order by score desc) as cum_n, sum(sum(label)) over (order by score desc) as cum_pos, sum(count(*)) over () as t_n from s group by score)
select score as boundary, cum_n::bigint as size, cum_pos::bigint as positives, round(cum_pos / cum_n::double, 9) as precision from c where cum_n >= ceil(t_n * 0.1::double) order by score desc limit 1""")
def top_group_lift(t):
    return rounded(ev.top_group(scored(t), 0.1), "precision")


@query(f"""with {SCORED}, k as (select source as cluster, sum((score - label) ** 2) as e, count(*) as c, row_number() over (order by source) - 1 as k, count(*) over () as total from s group by source),
d as (select rep, i, ('0x' || substr(sha256('17|' || rep || '|' || i), 1, 8))::bigint % (select max(total) from k) as k from (select unnest(range(50)) as rep), (select unnest(range((select max(total) from k))) as i)),
r as (select rep, sum(e) / sum(c) as v from d join k using (k) group by rep)
select count(*) as n_reps, round(quantile_cont(v, 0.025), 9) as low, round(quantile_cont(v, 0.5), 9) as mid, round(quantile_cont(v, 0.975), 9) as high from r""")
def cluster_bootstrap(t):
    return rounded(ev.bootstrap(scored(t), "source", 50, 17), "low", "mid", "high")


@query(f"""with {SCORED}, g as (select source as left_out, count(*) as g_n, sum((score - label) ** 2) as g_e from s group by source)
select left_out, (sum(g_n) over () - g_n)::bigint as n, round((sum(g_e) over () - g_e) / (sum(g_n) over () - g_n), 9) as brier from g""")
def leave_one_group_out(t):
    return rounded(ev.leave_one_out(scored(t), "source"), "brier")


@query(f"""with {SCORED}, p as (select distinct doc_id, lang from s where score >= 0.5), g as (select distinct doc_id, lang from s where label = 1),
f as (select coalesce(p.lang, g.lang) as lang, (p.doc_id is not null and g.doc_id is not null)::int as tp, (g.doc_id is null)::int as fp, (p.doc_id is null)::int as fn from p full join g on p.doc_id = g.doc_id and p.lang is not distinct from g.lang),
a as (select lang, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from f group by grouping sets ((), (lang)))
select lang, tp, fp, fn, round(tp / nullif(tp + fp, 0)::double, 9) as precision, round(tp / nullif(tp + fn, 0)::double, 9) as recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 9) as f1 from a""")
def pooled_prf(t):
    s = scored(t)
    flags = ev.match_triples(s.where("score >= 0.5"), s.where("label = 1"), ["doc_id", "lang"])
    return rounded(ev.pooled_prf(flags, "lang"), "precision", "recall", "f1")


@query(f"""with {SCORED}, b as (select case when label = 1 then 'good' else 'bad' end as left_label, case when score >= 0.6 then 'good' else 'bad' end as right_label from s),
cells as (select a as left_label, b as right_label from (values ('good'), ('bad')) x(a), (values ('good'), ('bad')) y(b)),
n as (select left_label, right_label, count(*) as n from b group by all), tot as (select count(*) as total, sum((left_label = right_label)::int) as same from b)
select left_label, right_label, coalesce(n, 0) as n, total, round(same / total::double, 9) as agreement from cells left join n using (left_label, right_label), tot""")
def agreement_report(t):
    s = scored(t)
    left = s.select("doc_id", F.when(F.col("label") == 1, "good").otherwise("bad").alias("label"))
    right = s.select("doc_id", F.when(F.col("score") >= 0.6, "good").otherwise("bad").alias("label"))
    return rounded(ev.agreement(left, right, "doc_id", ["good", "bad"]), "agreement")


@query("select source, lang, n, total, round(n / total::double, 9) as share from (select source, lang, count(*) as n, sum(count(*)) over ()::bigint as total from documents group by source, lang)")
def class_distribution(t):
    pairs = t.documents.select(F.struct("source", "lang").alias("k"))
    return rounded(ev.class_distribution(pairs, "k").select("k.source", "k.lang", "n", "total", "share"), "share")


@query("select o_orderpriority, count(*) as n, round(sum(o_totalprice), 4) as total, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.9), 6) as p90, round(quantile_cont(o_totalprice, 0.95), 6) as p95, max(o_totalprice) as largest from orders group by 1")
def numeric_summary(t):
    return rounded(rounded(ev.numeric_summary(t.orders, "o_totalprice", ["o_orderpriority"]), "median", "p90", "p95", digits=6), "total", digits=4)


@query("""with d as (select date_diff('day', o_orderdate::date, l_shipdate::date) as days, (l_returnflag = 'R')::int as label from orders join lineitem on o_orderkey = l_orderkey)
select count(*) as n, quantile_cont(days, 0.5) as median, round(avg(days), 9) as mean, min(days)::integer as shortest, max(days)::integer as longest from d where label = 1""")
def lead_time(t):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.datediff("l_shipdate", "o_orderdate").alias("days"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(ev.lead_time_summary(j, "days", "label"), "mean")


@query(f"""with {SCORED}, f as (select lang as family, score >= 0.7 as accepted, label = 1 as supported from s),
a as (select family, count(*) as labelled, sum(accepted::int)::bigint as accepted, sum(supported::int)::bigint as supported, sum((accepted and supported)::int)::bigint as true_accepts from f group by rollup (family))
select family, labelled, accepted, supported, true_accepts, accepted - true_accepts as false_accepts, round(true_accepts / greatest(accepted, 1)::double, 9) as precision, round(true_accepts / greatest(supported, 1)::double, 9) as retention from a""")
def family_gate(t):
    s = scored(t).select(F.col("lang").alias("family"), (F.col("score") >= 0.7).alias("accepted"), (F.col("label") == 1).alias("supported"))
    return rounded(ev.family_gate(s), "precision", "retention")


@query(f"""with {SCORED} select round(b, 9) as brier, round(p, 9) as prior_brier, round(1 - b / p, 9) as skill from (select avg((score - label) ** 2) as b, avg((0.12 - label) ** 2) as p from s)""")
def brier_skill(t):
    return rounded(ev.brier_skill(scored(t), 0.12), "brier", "prior_brier", "skill")


@query(
    f"with {SCORED}"
    + RANKS.format(by="", part="")
    + """, q as (select t_n::bigint as n, brier, auc, ap from m), f as (select *, list_filter([case when brier <= 0.2 then null else 'brier' end, case when auc >= 0.6 then null else 'auc' end, case when ap >= 0.5 then null else 'ap' end], lambda x: x is not null) as failed from q)
select n, array_to_string(failed, ',') as failed, case when n < 20 then 'INSUFFICIENT_SAMPLE' when len(failed) = 0 then 'PASS' when len(failed) * 2 <= 3 then 'PARTIAL' else 'FAIL' end as decision from f"""
)
def validation_gate(t):
    limits = {"brier": ("<=", 0.2), "auc": (">=", 0.6), "ap": (">=", 0.5)}
    return ev.gate(ev.rank_metrics(scored(t)), limits, 20).select("n", F.array_join("failed", ",").alias("failed"), "decision")


@query("""select count(*) as requests, sum(length(text))::bigint as tokens_in, sum(turn + 1)::bigint as tokens_out, count(*) as candidates, round((sum(length(text)) * 0.5 + sum(turn + 1) * 1.5) / 1e6, 9) as cost, round((sum(length(text)) * 0.5 + sum(turn + 1) * 1.5) / 1e6 / count(*), 12) as cost_per_candidate from conversations""")
def token_cost(t):
    usage = t.conversations.select(F.length("text").alias("tokens_in"), (F.col("turn") + 1).alias("tokens_out"), F.lit(1).alias("candidates"))
    return ev.token_cost(usage, 0.5, 1.5).withColumn("cost", F.round("cost", 9)).withColumn("cost_per_candidate", F.round("cost_per_candidate", 12))
