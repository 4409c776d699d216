"""Evaluation of scored predictions: rank metrics, calibration, agreement, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import saved

#: Ranges that distinct scores are dealt into for running sums; their totals are broadcast, so many rows at most.
RANGES = 64

#: Keys that are looked at to choose ranges of keys.
SAMPLE = 4096


def rate(correct: Column, total: Column) -> Column:
    """correct / total, null where total is 0."""
    return F.try_divide(correct.cast("double"), total)


def brier(score: Column, label: Column) -> Column:
    """Mean squared error of probabilities."""
    return F.avg(F.pow(score - label, 2))


def backtest_summary(runs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results and mean squared error of each run; a run without results has 0 and null."""
    return runs.join(results, key, "left").groupBy(key).agg(F.count("result_id").alias("results"), F.avg("brier_component").alias("brier"))


def distinct_scores(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """A row per distinct score with its rows `n` and positives `pos`; what rank metrics need."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def running(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`scores` with sums over all higher-or-equal scores (of the same group of `by`): cum_n, cum_pos.

    Distinct scores are dealt into at most RANGES ranges by quantiles; each range is summed by itself and
    moved by the totals of the ranges above, so that no task sorts all scores, nor all of a group. Groups
    with a null in `by` are left out. The scores are read three times and saved before.
    """
    scores = saved(scores)
    cuts = sorted(set(scores.approxQuantile("score", [i / RANGES for i in range(1, RANGES)], 0.01)))
    ranged = scores.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("score"))) if cuts else F.lit(0))
    totals = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("r_n"), F.sum("pos").alias("r_pos"))
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", F.coalesce(F.sum("r_n").over(above), F.lit(0)).alias("r_n"), F.coalesce(F.sum("r_pos").over(above), F.lit(0)).alias("r_pos"))
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    sums = ranged.join(totals if by else F.broadcast(totals), [*by, "_range"])
    return sums.withColumn("cum_n", F.sum("n").over(inside) + F.col("r_n")).withColumn("cum_pos", F.sum("pos").over(inside) + F.col("r_pos")).drop("_range", "r_n", "r_pos")


def rank_metrics(df: DataFrame, score: str = "score", label: str = "label", fraction: float = 0.2, by: Sequence[str] = ()) -> DataFrame:
    """One row (one for each group of `by`): n, positives, brier, ap, auc, lift, prevalence, threshold metrics at 0.5.

    Ties count half in auc (null if a class is empty) and as one threshold in ap (null without positives).
    lift is the precision among the floor((n + 4) / 5) highest scores, all ties of the last included,
    over the prevalence (F10-F13). No pair of rows is ever formed.
    """
    per = running(distinct_scores(df, score, label, by), by)
    total = per.groupBy(*by).agg(F.sum("n").alias("t_n"), F.sum("pos").alias("t_pos"))
    joined = per.join(total, list(by)) if by else per.crossJoin(F.broadcast(total))
    neg = F.col("n") - F.col("pos")
    below = (F.col("t_n") - F.col("t_pos")) - (F.col("cum_n") - F.col("cum_pos"))
    error = F.col("pos") * F.pow(F.col("score") - 1, 2) + neg * F.pow(F.col("score"), 2)
    least = F.floor((F.col("t_n") + 4) * fraction) if fraction == 0.2 else F.ceil(F.col("t_n") * fraction)
    top = F.struct(F.col("score"), F.col("cum_n"), F.col("cum_pos"))
    hit = F.col("score") >= 0.5
    return (
        joined.groupBy(*by, "t_n", "t_pos")
        .agg(
            (F.sum(error) / F.first("t_n")).alias("brier"),
            F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("ap"),
            F.sum(F.col("pos") * (below + neg / 2)).alias("wins"),
            F.max(F.when(F.col("cum_n") >= least, top)).alias("top"),
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        )
        .select(
            *by,
            F.col("t_n").alias("n"),
            F.col("t_pos").alias("positives"),
            "brier",
            F.try_divide("ap", "t_pos").alias("ap"),
            F.try_divide(F.col("wins"), F.col("t_pos") * (F.col("t_n") - F.col("t_pos"))).alias("auc"),
            F.try_divide(F.col("top.cum_pos") / F.col("top.cum_n"), F.col("t_pos") / F.col("t_n")).alias("lift"),
            (F.col("t_pos") / F.col("t_n")).alias("prevalence"),
            F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide("tp", "t_pos"), F.lit(0.0)).alias("recall"),
            "fp",
            (F.col("t_pos") - F.col("tp")).alias("fn"),
        )
    )


def top_group(df: DataFrame, fraction: float, score: str = "score", label: str = "label") -> DataFrame:
    """boundary, size, positives, precision of the ceil(n * fraction) highest scores with all ties."""
    per = running(distinct_scores(df, score, label))
    total = per.agg(F.sum("n").alias("t_n"))
    cut = per.crossJoin(F.broadcast(total)).where(F.col("cum_n") >= F.ceil(F.col("t_n") * F.lit(fraction)))
    best = cut.agg(F.max(F.struct("score", "cum_n", "cum_pos")).alias("b"))
    return best.select(F.col("b.score").alias("boundary"), F.col("b.cum_n").alias("size"), F.col("b.cum_pos").alias("positives"), F.try_divide("b.cum_pos", "b.cum_n").alias("precision"))


def calibration(df: DataFrame, edges: Sequence[float], keep_empty: bool, score: str = "score", label: str = "label") -> DataFrame:
    """bin, low, high, n, mean_score, observed: bins [low, high), the last one closed.

    The edges are literals, so that scores on an edge fall as the edge's own double says. Empty bins
    are left out, or kept with 0.0.
    """
    spark = df.sparkSession
    pairs = list(zip(edges, edges[1:]))
    bin_of = F.lit(None).cast("int")
    for i, (low, high) in enumerate(pairs):
        p = F.col(score)
        inside = (p >= low) & ((p < high) if i + 1 < len(pairs) else (p <= high))
        bin_of = F.when(inside, i).otherwise(bin_of)
    found = df.select(bin_of.alias("bin"), F.col(score).alias("p"), F.col(label).alias("y")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"), F.avg("y").alias("observed"))
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "bin int, low double, high double")
    joined = F.broadcast(bins).join(found, "bin", "left" if keep_empty else "inner")
    return joined.select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("observed", F.lit(0.0)).alias("observed"))


def match_triples(predicted: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of both sides with tp, fp, fn as 0 or 1."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, list(keys), "full_outer").withColumn("_p", F.coalesce("_p", F.lit(0))).withColumn("_g", F.coalesce("_g", F.lit(0)))
    return both.select(*keys, (F.col("_p") * F.col("_g")).alias("tp"), (F.col("_p") * (1 - F.col("_g"))).alias("fp"), ((1 - F.col("_p")) * F.col("_g")).alias("fn"))


def pooled_prf(flags: DataFrame, *levels: str) -> DataFrame:
    """precision, recall, f1 overall and by each of `levels`; null where a denominator is 0."""
    sets = ", ".join(["()", *(f"({c})" for c in levels)])
    flags.createOrReplaceTempView("_tidemark_flags")
    sums = flags.sparkSession.sql(f"select {', '.join(levels)}, grouping_id() as level, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from _tidemark_flags group by grouping sets ({sets})")
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*levels, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def agreement(left: DataFrame, right: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """The whole confusion matrix of two labellings with zero cells, and the raw agreement."""
    spark = left.sparkSession
    both = left.select(key, F.col("label").alias("left_label")).join(right.select(key, F.col("label").alias("right_label")), key)
    counts = both.groupBy("left_label", "right_label").agg(F.count(F.lit(1)).alias("n"))
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], "left_label string, right_label string")
    total = both.agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("left_label") == F.col("right_label")).cast("long")).alias("same"))
    full = F.broadcast(cells).join(counts, ["left_label", "right_label"], "left").crossJoin(F.broadcast(total))
    return full.select("left_label", "right_label", F.coalesce("n", F.lit(0)).alias("n"), "total", rate(F.col("same"), F.col("total")).alias("agreement"))


def material_agreement(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Rows that both sides answer YES with `agree`: the same fields, and the same texts but for case and white space."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a, b = left.alias("a"), right.alias("b")
    yes = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).where((F.col("a.label") == "YES") & (F.col("b.label") == "YES"))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    for c in texts:
        same = same & plain(F.col(f"a.{c}")).eqNullSafe(plain(F.col(f"b.{c}")))
    return yes.select(F.col(f"a.{key}").alias(key), same.alias("agree"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """label, n, total, share (D7). The total is a global aggregate, not a window over all rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).withColumn("share", F.col("n") / F.col("total"))


def numeric_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, total, median, p90, p95, max with linear interpolation."""
    q = F.expr(f"percentile({value}, array(0.5, 0.9, 0.95))")
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), q.alias("q"), F.max(value).alias("largest"))
    return out.select(*by, "n", "total", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p95"), "largest")


def lead_time_summary(df: DataFrame, days: str, label: str) -> DataFrame:
    """Of positives: n, median, mean, shortest and longest lead."""
    d = df.where(F.col(label) == 1).select(F.col(days).alias("d"))
    return d.agg(F.count("d").alias("n"), F.expr("percentile(d, 0.5)").alias("median"), F.avg("d").alias("mean"), F.min("d").alias("shortest"), F.max("d").alias("longest"))


def extraction_quality(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """accuracy, recall, missing_rate, duplicate_rate, provenance_rate of extracted values against gold."""
    first = predicted.groupBy(key).agg(F.min_by("value", "ordinal").alias("value"))
    joined = gold.select(key, F.col("value").alias("gold_value")).join(first, key, "left")
    found = F.col("value").isNotNull()
    sums = joined.agg(F.count(F.lit(1)).alias("gold"), F.count(F.when(found, 1)).alias("found"), F.count(F.when(F.col("value") == F.col("gold_value"), 1)).alias("right"))
    rows = predicted.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.count(F.when(F.col("source_hash").isNotNull(), 1)).alias("sourced"))
    both = sums.crossJoin(F.broadcast(rows))
    return both.select("gold", "found", rate(F.col("right"), F.col("found")).alias("accuracy"), rate(F.col("right"), F.col("gold")).alias("recall"), (1 - rate(F.col("found"), F.col("gold"))).alias("missing_rate"), (1 - rate(F.col("keys"), F.col("rows"))).alias("duplicate_rate"), rate(F.col("sourced"), F.col("rows")).alias("provenance_rate"))


def severe_errors(matched: DataFrame) -> DataFrame:
    """Counts of wrong sign, period, basis and scale (a thousandfold) in value / gold_value pairs."""
    v, g = F.col("value"), F.col("gold_value")
    big = (F.greatest(F.abs(v), F.abs(g)) >= 1000 * F.least(F.abs(v), F.abs(g))) & (v != g)
    return matched.agg(F.count(F.when(F.signum(v) * F.signum(g) < 0, 1)).alias("wrong_sign"), F.count(F.when(F.col("period") != F.col("gold_period"), 1)).alias("wrong_period"), F.count(F.when(big, 1)).alias("wrong_scale"), F.count(F.when(F.col("basis") != F.col("gold_basis"), 1)).alias("wrong_basis"))


def numeric_match(predicted: DataFrame, gold: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Gold rows with the prediction of the same keys: `found`, `same_value` and `same_<field>`."""
    p = predicted.select(*keys, F.col("value").alias("p_value"), *(F.col(c).alias(f"p_{c}") for c in fields), F.lit(True).alias("found"))
    joined = gold.join(p, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))
    near = F.abs(F.col("value") - F.col("p_value")) <= tolerance * F.greatest(F.lit(1.0), F.abs("value"))
    return joined.select(*keys, "found", F.coalesce(near, F.lit(False)).alias("same_value"), *((F.col("found") & F.col(c).eqNullSafe(F.col(f"p_{c}"))).alias(f"same_{c}") for c in fields))


def family_gate(df: DataFrame) -> DataFrame:
    """Per family and in all (null): labelled, accepted, supported, true accepts, precision, retention.

    Denominators of 0 count as 1, so an empty family has 0.0.
    """
    flags = df.select("family", F.col("accepted").cast("long").alias("a"), F.col("supported").cast("long").alias("s"))
    sums = flags.rollup("family").agg(F.count(F.lit(1)).alias("labelled"), F.sum("a").alias("accepted"), F.sum("s").alias("supported"), F.sum(F.col("a") * F.col("s")).alias("true_accepts"))
    return sums.select("family", "labelled", "accepted", "supported", "true_accepts", (F.col("accepted") - F.col("true_accepts")).alias("false_accepts"), (F.col("true_accepts") / F.greatest(F.col("accepted"), F.lit(1))).alias("precision"), (F.col("true_accepts") / F.greatest(F.col("supported"), F.lit(1))).alias("retention"))


def confusion_by_family(labels: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """tp, fp, missed and true rejections overall and per family (D24); an absent decision is a rejection."""
    joined = labels.join(decisions.select(key, "accepted"), key, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    kind = F.when(F.col("accepted") & F.col("supported"), "tp").when(F.col("accepted"), "fp").when(F.col("supported"), "missed").otherwise("true_rejection")
    return joined.withColumn("kind", kind).rollup("family").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("tp", "fp", "missed", "true_rejection")))


def job_accuracy(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Share of gold postings found, and of those with the same function, seniority and location."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    f = found.select(key, *(F.col(c).alias(f"f_{c}") for c in ("function", "seniority", "location")), F.lit(1).alias("hit"))
    j = gold.join(f, key, "left")
    share = lambda c: F.avg(F.when(F.col("hit") == 1, c.cast("double")))
    return j.agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found"), share(F.col("function") == F.col("f_function")).alias("function_rate"), share(F.col("seniority") == F.col("f_seniority")).alias("seniority_rate"), share(plain(F.col("location")) == plain(F.col("f_location"))).alias("location_rate"))


def expectation_accuracy(cases: DataFrame, extracted: DataFrame) -> DataFrame:
    """cases (case_id, expected_type, expects) against extracted (case_id, event_type): rate and failing ids."""
    hits = extracted.select("case_id", F.col("event_type").alias("expected_type")).distinct().withColumn("hit", F.lit(True))
    judged = cases.join(hits, ["case_id", "expected_type"], "left").withColumn("ok", F.coalesce("hit", F.lit(False)) == F.col("expects"))
    return judged.agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("ok").cast("double")).alias("rate"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("case_id")))).alias("failing"))


def token_cost(usage: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """requests, tokens, cost and cost per candidate at prices per million tokens."""
    sums = usage.agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("candidates").alias("candidates"))
    cost = (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6
    return sums.withColumn("cost", cost).withColumn("cost_per_candidate", F.try_divide(cost, F.col("candidates")))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, which differ in `key`, with their number `k` in its order, from 0; a null key is first.

    The keys are dealt into at most RANGES ranges, cut at those of the SAMPLE keys of the least hash;
    each range is numbered by itself and moved by the counts of those before.
    """
    picked = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE).collect())
    cuts = sorted({picked[i * len(picked) // RANGES] for i in range(1, RANGES)}) if picked else []
    ranged = rows.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.join(F.broadcast(counts), "_range").withColumn("k", inside - 1 + F.col("_before")).drop("_range", "_before")


def bootstrap(df: DataFrame, cluster: str, reps: int, seed: int, statistic: str = "brier", score: str = "score", label: str = "label") -> DataFrame:
    """n_reps, low, mid, high: percentiles 2.5, 50, 97.5 of the mean squared error over resampled clusters.

    Clusters are first summed to one row each; a replicate draws as many clusters as there are, the ith by
    a hash of seed, replicate and i, so that the result is the same anywhere. The draws are reps times
    clusters rows, joined to the clusters by number.
    """
    error = F.pow(F.col(score) - F.col(label), 2)
    sums = df.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(error).alias("e"), F.count(F.lit(1)).alias("c"))
    k = sums.count()
    if not k:
        return df.sparkSession.createDataFrame([], "n_reps long, low double, mid double, high double")
    draws = df.sparkSession.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string")), 256), 1, 8)
    draws = draws.select("rep", F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(k)).alias("k"))
    stats = draws.join(numbered(sums, "cluster"), "k").groupBy("rep").agg((F.sum("e") / F.sum("c")).alias("v"))
    q = F.expr("percentile(v, array(0.025, 0.5, 0.975))")
    return stats.agg(F.count(F.lit(1)).alias("n_reps"), q.alias("q")).select("n_reps", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


def brier_skill(df: DataFrame, prior: float, score: str = "score", label: str = "label") -> DataFrame:
    """1 - brier / brier of a constant prior."""
    s = df.agg(brier(F.col(score), F.col(label)).alias("brier"), brier(F.lit(prior), F.col(label)).alias("prior_brier"))
    return s.withColumn("skill", 1 - F.try_divide("brier", "prior_brier"))


def leave_one_out(df: DataFrame, group: str, score: str = "score", label: str = "label") -> DataFrame:
    """left_out, n, brier without each group, by taking the group's sums from the totals."""
    error = F.pow(F.col(score) - F.col(label), 2)
    per = df.groupBy(F.col(group).alias("left_out")).agg(F.count(F.lit(1)).alias("g_n"), F.sum(error).alias("g_e"))
    total = per.agg(F.sum("g_n").alias("t_n"), F.sum("g_e").alias("t_e"))
    return per.crossJoin(F.broadcast(total)).select("left_out", (F.col("t_n") - F.col("g_n")).alias("n"), F.try_divide(F.col("t_e") - F.col("g_e"), F.col("t_n") - F.col("g_n")).alias("brier"))


def gate(metrics: DataFrame, thresholds: dict[str, tuple[str, float]], least_n: int) -> DataFrame:
    """`metrics` with failed (names of criteria not met) and decision.

    thresholds: column to ('>=' or '<=', value). Null metrics fail. Decisions: INSUFFICIENT_SAMPLE, PASS,
    PARTIAL (at least half is met), FAIL.
    """
    tests = [F.when(F.coalesce(F.col(c) >= v if op == ">=" else F.col(c) <= v, F.lit(False)), None).otherwise(F.lit(c)) for c, (op, v) in thresholds.items()]
    out = metrics.withColumn("failed", F.array_compact(F.array(*tests)))
    few = F.size("failed") * 2 <= len(thresholds)
    return out.withColumn("decision", F.when(F.col("n") < least_n, "INSUFFICIENT_SAMPLE").when(F.size("failed") == 0, "PASS").when(few, "PARTIAL").otherwise("FAIL"))


def failure_stages(df: DataFrame) -> DataFrame:
    """Misses and false accepts by the stage that caused them, with shares.

    Columns generated, filtered, verified, supported are booleans of a candidate's way through the stages.
    """
    stage = F.when(F.col("supported") & ~F.col("generated"), "not_generated").when(F.col("supported") & ~F.col("filtered"), "filtered_out").when(F.col("supported") & ~F.col("verified"), "rejected_by_verifier").when(~F.col("supported") & F.col("verified"), "false_accept").otherwise("none")
    return class_distribution(df.withColumn("stage", stage).where(F.col("stage") != "none"), "stage")


def readiness_checklist(cases: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Per family: positive, negative and ambiguous cases, adversary kinds, mismatches, READY or NOT_READY."""
    per = cases.groupBy("family").agg(F.bool_or(F.col("expected") == "accept").alias("positive"), F.bool_or(F.col("expected") == "reject").alias("negative"), F.bool_or(F.col("expected") == "ambiguous").alias("ambiguous"), F.array_sort(F.collect_set("kind")).alias("seen"), F.count(F.when(F.col("expected") != F.col("actual"), 1)).alias("mismatches"))
    ready = F.col("positive") & F.col("negative") & F.col("ambiguous") & (F.size(F.array_except(F.array(*map(F.lit, kinds)), "seen")) == 0) & (F.col("mismatches") == 0)
    return per.withColumn("status", F.when(ready, "READY").otherwise("NOT_READY"))
