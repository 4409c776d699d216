"""Features over time: changes, persistence, snapshots, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_change(df: DataFrame, by: Sequence[str], percent_points: bool = False) -> DataFrame:
    """Change between the last two periods of each group of `by`, of the same currency and unit.

    Periods are ordered by coalesce(observation_date, publication_date), then period. A prior of zero
    gives no row, unless the values are percent points: then the change is in basis points.
    """
    order = [F.coalesce("observation_date", "publication_date"), F.col("period")]
    w = Window.partitionBy(*by).orderBy(*order)
    down = Window.partitionBy(*by).orderBy(*(c.desc() for c in order))
    prior = lambda c: F.lag(c).over(w).alias(f"prior_{c}")
    last = df.select(*by, "period", "value", "currency", "unit", prior("period"), prior("value"), prior("currency"), prior("unit"), F.row_number().over(down).alias("_r")).where("_r = 1")
    same = F.col("currency").eqNullSafe(F.col("prior_currency")) & F.col("unit").eqNullSafe(F.col("prior_unit")) & F.col("prior_value").isNotNull()
    change = (F.col("value") - F.col("prior_value")) * 100 if percent_points else (F.col("value") - F.col("prior_value")) / F.abs("prior_value")
    kept = last.where(same if percent_points else same & (F.col("prior_value") != 0))
    return kept.select(*by, "prior_period", "period", "prior_value", "value", change.alias("bps_change" if percent_points else "pct_change"))


def event_period_features(df: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    """Of each group's latest period: count, change from the period before, new_flag, persistence.

    Periods are compared as strings. persistence is the number of periods with an event.
    """
    counts = df.groupBy(*by, F.col(period).cast("string").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("period")
    all_ = Window.partitionBy(*by)
    rows = counts.withColumn("prior", F.lag("n").over(w)).withColumn("persistence", F.count(F.lit(1)).over(all_)).withColumn("last", F.max("period").over(all_))
    return rows.where(F.col("period") == F.col("last")).select(*by, "period", "n", (F.col("n") - F.coalesce("prior", F.lit(0))).alias("change"), (F.col("persistence") == 1).alias("new_flag"), "persistence")


def novelty(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with novelty: the first row of each group is new, the rest persistent."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumn("novelty", F.when(first, "new").otherwise("persistent"))


def snapshot_velocity(df: DataFrame, by: Sequence[str], ts: str = "ts", count: str = "open_count") -> DataFrame:
    """Each snapshot's delta, ratio to the one before (at least 1) and change per day (at least one day)."""
    w = Window.partitionBy(*by).orderBy(ts)
    d = df.withColumn("_p", F.lag(count).over(w)).withColumn("_t", F.lag(ts).over(w))
    delta = F.col(count) - F.col("_p")
    days = F.datediff(ts, "_t")
    return d.where(F.col("_p").isNotNull()).select(*by, ts, count, delta.alias("delta"), (delta / F.greatest("_p", F.lit(1))).alias("acceleration"), (delta / F.greatest(days, F.lit(1))).alias("velocity"))


def page_changes(df: DataFrame, by: Sequence[str], order: str, digest: str) -> DataFrame:
    """`df` with changed: the hash is not that of the snapshot before; the first is changed."""
    before = F.lag(digest).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("changed", ~before.eqNullSafe(F.col(digest)) | (F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1))


def careers_history(snapshots: DataFrame, lifecycle: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per snapshot: new, persistent, closed so far; absent once and reopened for the latest only."""
    latest = F.max("ts").over(Window.partitionBy(*keys))
    s = snapshots.select(*keys, "ts").withColumn("is_latest", F.col("ts") == latest)
    j = s.join(lifecycle, list(keys), "left")
    n = lambda c: F.count(F.when(c, 1))
    seen = (F.col("first_seen") < F.col("ts")) & (F.col("last_seen") >= F.col("ts"))
    return j.groupBy(*keys, "ts", "is_latest").agg(n(F.col("first_seen") == F.col("ts")).alias("new"), n(seen).alias("persistent"), n(F.col("closed_at") <= F.col("ts")).alias("closed"), n(F.col("is_latest") & (F.col("misses") == 1)).alias("absent_once"), F.sum(F.when(F.col("is_latest"), F.coalesce("reopened", F.lit(0))).otherwise(0)).alias("reopened"))


def ordered_values(df: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """The days and values of each group in order, as arrays; for groups of bounded length such as snapshots."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(pairs.alias("p")).select(*by, F.transform("p", lambda x: x["t"]).alias("times"), F.transform("p", lambda x: x["v"]).alias("values"))


def _steps(a: Column, f) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: f(F.get(a, i), F.get(a, i - 1)))


def history_context(df: DataFrame, by: Sequence[str], ts: str, least: int = 4) -> DataFrame:
    """Intervals in days, consistency (each within a quarter of the mean, from two on) and depth label."""
    a = ordered_values(df, by, ts, ts)
    gaps = F.when(F.size("times") > 1, _steps(F.col("times"), lambda x, y: F.datediff(x, y))).otherwise(F.array().cast("array<int>"))
    mean = F.aggregate("gaps", F.lit(0.0), lambda s, x: s + x) / F.size("gaps")
    worst = F.array_max(F.transform("gaps", lambda x: F.abs(x - F.col("mean")))) / F.col("mean")
    out = a.select(*by, F.size("times").alias("snapshots"), gaps.alias("gaps")).withColumn("mean", F.when(F.size("gaps") > 0, mean))
    even = F.when(F.size("gaps") < 2, "NOT_ASSESSED").when((F.col("mean") > 0) & (worst <= 0.25), "CONSISTENT").otherwise("IRREGULAR")
    depth = F.when(F.col("snapshots") == 1, "SINGLE").when(F.col("snapshots") >= least, "SUFFICIENT_FOR_POLICY").otherwise("SHALLOW")
    return out.withColumn("consistent", even).withColumn("depth", depth)


def persistence_status(df: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """NOT_ASSESSED, STABLE, REVERSED, ACCELERATING, PERSISTENT or ONE_OFF from the changes between snapshots.

    Fewer than two snapshots are not assessed; no change at all is stable; changes of both signs are
    reversed (and a contradiction); a single non-zero change is one-off; growing sizes are accelerating.
    """
    a = ordered_values(df, by, ts, value)
    changes = F.when(F.size("values") > 1, _steps(F.col("values"), lambda x, y: x - y)).otherwise(F.array().cast(df.select(F.array(value)).schema[0].dataType))
    out = a.select(*by, F.size("values").alias("snapshots"), changes.alias("changes"))
    moved = F.filter("changes", lambda x: x != 0)
    both = F.exists("changes", lambda x: x > 0) & F.exists("changes", lambda x: x < 0)
    sizes = F.transform(moved, lambda x: F.abs(x))
    grows = F.forall(F.sequence(F.lit(1), F.size(sizes) - 1), lambda i: F.get(sizes, i) > F.get(sizes, i - 1))
    status = F.when(F.col("snapshots") < 2, "NOT_ASSESSED").when(F.size(moved) == 0, "STABLE").when(both, "REVERSED").when(F.size(moved) == 1, "ONE_OFF").when(grows, "ACCELERATING").otherwise("PERSISTENT")
    return out.withColumn("persistence", status).withColumn("contradiction", both)


def mix_trajectory(mix: DataFrame, snapshots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of each key over all of its group's snapshots in order; null where only a summary is kept."""
    keys = mix.select(*by, "key").distinct()
    grid = keys.join(snapshots.select(*by, "ts", "legacy"), list(by))
    full = grid.join(mix, [*by, "key", "ts"], "left")
    value = F.when(~F.col("legacy"), F.coalesce("n", F.lit(0)))
    return full.groupBy(*by, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", value.alias("v")))), lambda x: x["v"]).alias("counts"))


def source_health(df: DataFrame, by: Sequence[str], as_of: Column, ts: str = "ts", count: str = "open_count") -> DataFrame:
    """Latest count, change from the one before, anomaly (a drop of 80 % from 10 or more), stale past next_due."""
    down = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ts).desc()))
    two = df.withColumn("_r", down).where("_r <= 2").groupBy(*by).agg(F.max(F.when(F.col("_r") == 1, F.col(ts))).alias("latest"), F.max(F.when(F.col("_r") == 1, F.col(count))).alias("open_count"), F.max(F.when(F.col("_r") == 2, F.col(count))).alias("prior"), F.max(F.when(F.col("_r") == 1, F.col("next_due"))).alias("next_due"))
    return two.select(*by, "latest", "open_count", (F.col("open_count") - F.col("prior")).alias("delta"), F.coalesce((F.col("prior") >= 10) & (F.col("open_count") <= 0.2 * F.col("prior")), F.lit(False)).alias("anomaly"), (as_of > F.col("next_due")).alias("stale"))


def change_feed(observations: DataFrame, careers: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """company, ts, kind, n: accepted observations and the kinds of careers change that are not zero, newest first."""
    a = observations.select("company", "ts", F.lit("observation").alias("kind"), F.lit(1).cast("long").alias("n"))
    b = careers.select("company", "ts", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("n")) for k in kinds))).alias("p")).select("company", "ts", "p.*").where("n <> 0")
    return a.unionByName(b).orderBy(F.desc("ts"), "company", "kind")


def since_previous(feed: DataFrame) -> DataFrame:
    """Careers rows of a company's latest snapshot, and others newer than its snapshot before."""
    careers = feed.where("kind <> 'observation'").select("company", "ts").distinct()
    r = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("ts")))
    marks = careers.withColumn("_r", r).groupBy("company").agg(F.max(F.when(F.col("_r") == 1, F.col("ts"))).alias("_last"), F.max(F.when(F.col("_r") == 2, F.col("ts"))).alias("_before"))
    j = feed.join(marks, "company", "left")
    own = (F.col("kind") != "observation") & (F.col("ts") == F.col("_last"))
    other = (F.col("kind") == "observation") & (F.col("_before").isNull() | (F.col("ts") > F.col("_before")))
    return j.where(own | other).drop("_last", "_before")


def feed_period(feed: DataFrame, days: int) -> DataFrame:
    """Rows of the last days before the latest one in the feed."""
    latest = feed.agg(F.max("ts").alias("_m"))
    return feed.crossJoin(F.broadcast(latest)).where(F.col("ts") > F.col("_m") - F.make_dt_interval(F.lit(days))).drop("_m")


def latest_dates(companies: DataFrame, *sources: tuple[DataFrame, str]) -> DataFrame:
    """company, latest: the greatest date over the sources, else the company's own fallback date."""
    out, names = companies, []
    for i, (d, c) in enumerate(sources):
        out = out.join(d.groupBy("company").agg(F.max(c).alias(f"_d{i}")), "company", "left")
        names.append(f"_d{i}")
    found = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return out.withColumn("latest", F.coalesce(found, "fallback")).drop(*names)


def release_versions(df: DataFrame, by: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """`df` with version: one more where the hash is not that of the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.when(F.lag(digest).over(w).eqNullSafe(F.col(digest)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("version", F.sum("_c").over(w)).drop("_c")


def link_reposts(new: DataFrame, closed: DataFrame) -> DataFrame:
    """New postings with repost_of: the last closed posting of the same title and location."""
    key = lambda: F.concat_ws("|", F.lower(F.trim(F.regexp_replace("title", r"\s+", " "))), F.lower(F.coalesce("location", F.lit(""))))
    last = closed.select(key().alias("_k"), "identity", "closed_at").groupBy("_k").agg(F.max_by("identity", F.struct("closed_at", "identity")).alias("repost_of"))
    return new.withColumn("_k", key()).join(last, "_k", "left").drop("_k")


def longitudinal_accuracy(expected: DataFrame, facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per metric: how many expected percent changes follow from the facts of both documents."""
    f = lambda p: facts.select(F.col("document").alias(f"{p}_document"), "metric", F.col("value").alias(f"{p}_value"), F.col("currency").alias(f"{p}_currency"))
    j = expected.join(f("prior"), ["prior_document", "metric"], "left").join(f("current"), ["current_document", "metric"], "left")
    change = F.when(F.col("prior_currency").eqNullSafe(F.col("current_currency")) & (F.col("prior_value") != 0), (F.col("current_value") - F.col("prior_value")) / F.abs("prior_value") * 100)
    ok = F.coalesce(F.abs(change - F.col("expected_change")) <= tolerance, F.lit(False))
    return j.groupBy("metric").agg(F.count(F.lit(1)).alias("expected"), F.count(F.when(ok, 1)).alias("right"))


def feature_pairs(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected percent change between the last two annual periods with the ids it comes from."""
    w = Window.partitionBy(*by).orderBy(F.desc("period"))
    two = facts.where(F.col("annual")).withColumn("_r", F.row_number().over(w)).withColumn("prior", F.lead(F.struct("id", "period", "value", "currency")).over(w)).where("_r = 1 and prior is not null")
    ok = F.col("prior.currency").eqNullSafe(F.col("currency")) & (F.col("prior.value") != 0)
    return two.where(ok).select(*by, F.col("prior.period").alias("prior_period"), "period", ((F.col("value") - F.col("prior.value")) / F.abs("prior.value") * 100).alias("pct_change"), F.array("prior.id", "id").alias("inputs"))


# ---- aggregates over snapshots ------------------------------------------------------------


def snapshot_mix(df: DataFrame, by: Sequence[str], dimensions: dict[str, str]) -> DataFrame:
    """by, dimension, counts map: the rows of each value of each dimension, null as `unknown`.

    Array columns count each element. One pass: rows are spread to (dimension, value) pairs and counted
    before the shuffle.
    """
    arrays = {c for c, t in df.dtypes if t.startswith("array")}

    def pair(name: str):
        return lambda v: F.struct(F.lit(name).alias("dimension"), F.coalesce(v.cast("string"), F.lit("unknown")).alias("value"))

    pairs = [F.transform(F.col(c), pair(name)) if c in arrays else F.array(pair(name)(F.col(c))) for name, c in dimensions.items()]
    return df.select(*by, F.explode(F.flatten(F.array(*pairs))).alias("p")).groupBy(*by, "p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def as_maps(mix: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counts of each dimension as a map; its values are the dimension's categories."""
    return mix.groupBy(*by, "dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def role_shares(df: DataFrame, by: Sequence[str], title: str, patterns: dict[str, str]) -> DataFrame:
    """Share of distinct titles that match each role; strength min(1, share / 0.40), materiality min(1, n / 5); no zeros (D3)."""
    t = df.select(*by, F.lower(title).alias("t")).distinct()
    sums = t.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.sum(F.col("t").rlike(p).cast("long")).alias(f"_{k}") for k, p in patterns.items()))
    long = sums.select(*by, "total", F.explode(F.array(*(F.struct(F.lit(k).alias("role"), F.col(f"_{k}").alias("n")) for k in patterns))).alias("p")).select(*by, "total", "p.*").where("n > 0")
    share = F.col("n") / F.col("total")
    return long.select(*by, "role", "n", share.alias("share"), F.least(F.lit(1.0), share / 0.40).alias("strength"), F.least(F.lit(1.0), F.col("n") / 5).alias("materiality"))


def mix_change(now: DataFrame, before: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Count, change and share of each key between two periods; share null for an empty period."""
    count = lambda d, n: d.groupBy(*by, key).agg(F.count(F.lit(1)).alias(n))
    j = count(now, "n").join(count(before, "prior"), [*by, key], "full_outer").fillna(0, ["n", "prior"])
    total = j.groupBy(*by).agg(F.sum("n").alias("total"))
    return j.join(total, list(by)).select(*by, key, "n", (F.col("n") - F.col("prior")).alias("change"), F.try_divide("n", "total").alias("share"))


def new_and_closed(now: DataFrame, before: DataFrame, by: Sequence[str], identity: str) -> DataFrame:
    """How many identities appeared and went between two periods."""
    a = now.select(*by, identity).distinct().withColumn("_n", F.lit(1))
    b = before.select(*by, identity).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, [*by, identity], "full_outer")
    return j.groupBy(*by).agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("new"), F.count(F.when(F.col("_n").isNull(), 1)).alias("closed"))


def dedupe_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def dedupe_merge(df: DataFrame, keys: Sequence[str], newest: str, values: Sequence[str]) -> DataFrame:
    """The newest row's values of each key, with the first and last time it was seen."""
    row = F.max_by(F.struct(*values), F.struct(newest, *values)).alias("v")
    return df.groupBy(*keys).agg(row, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).select(*keys, *(F.col(f"v.{c}").alias(c) for c in values), "first_seen", "last_seen")


def merge_events(df: DataFrame) -> DataFrame:
    """Observations of a company, type, period and span (signs and case aside) as one event."""
    span = F.trim(F.regexp_replace(F.lower("span"), "[^a-z0-9]+", " ")).alias("span_key")
    return df.groupBy("company", "event_type", "period", span).agg(F.array_sort(F.collect_set("observation_id")).alias("observation_ids"), F.min_by("attributes", "observation_id").alias("attributes"))


def profile_counts(lifecycle: DataFrame, by: Sequence[str]) -> DataFrame:
    """open, new (first seen at the latest time), absent, closed, reopened of each group."""
    latest = F.max("last_seen").over(Window.partitionBy(*by))
    n = lambda c: F.count(F.when(c, 1))
    return lifecycle.withColumn("_l", latest).groupBy(*by).agg(n(F.col("status") == "open").alias("open"), n(F.col("first_seen") == F.col("_l")).alias("new"), n((F.col("status") == "open") & (F.col("misses") > 0)).alias("absent"), n(F.col("status") == "closed").alias("closed"), F.sum("reopened").alias("reopened"))


def source_coverage(df: DataFrame, by: Sequence[str], families: Sequence[str]) -> DataFrame:
    """Families present and missing, evidence count, whether every row has a hash."""
    present = F.array_sort(F.collect_set("family"))
    out = df.groupBy(*by).agg(present.alias("present"), F.count(F.lit(1)).alias("evidence"), F.bool_and(F.col("source_hash").isNotNull()).alias("provenance_complete"))
    return out.withColumn("missing", F.array_except(F.array(*map(F.lit, sorted(families))), "present"))


def activity_by_month(df: DataFrame, by: Sequence[str], day: str, key: str) -> DataFrame:
    """Records and their ids by month; months without records are absent."""
    return df.groupBy(*by, F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))
