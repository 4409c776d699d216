"""Point-in-time filters: only what was available at the cutoff may count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def end_of_day(value: Column) -> Column:
    """The last microsecond of a date, UTC; date-only strings mean this."""
    return F.date_add(value.cast("date"), 1).cast("timestamp") - F.expr("interval 1 microsecond")


def as_of(df: DataFrame, cutoff: str, clock: str = "available_at") -> DataFrame:
    """Rows available at `cutoff`; a cutoff without a time means the end of that day (B1). Null clocks drop out."""
    at = end_of_day(F.lit(cutoff)) if len(cutoff) == 10 else F.lit(cutoff).cast("timestamp")
    return df.where(F.col(clock) <= at)


def eligible_observations(df: DataFrame, as_of_date: str) -> DataFrame:
    """Accepted or corrected rows available by the date (B2)."""
    return df.where((F.to_date("available_at") <= F.lit(as_of_date).cast("date")) & F.col("status").isin("accepted", "corrected"))


def in_outcome_window(cutoff: Column, window_end: Column, event: Column) -> Column:
    """cutoff < event <= window_end."""
    return (event > cutoff) & (event <= window_end)


def active_as_of(df: DataFrame, day: str, first: str = "first_seen", closed: str = "closed_at") -> DataFrame:
    """Rows open on a day: seen by its end and not closed by then."""
    d = F.lit(day).cast("date")
    return df.where((F.to_date(first) <= d) & (F.col(closed).isNull() | (F.to_date(closed) > d)))


def active_on_days(df: DataFrame, days: DataFrame, first: str = "first_seen", closed: str = "closed_at") -> DataFrame:
    """day, active: how many rows are open on each day of a spine.

    Openings and closings are counted per day, so rows are never paired with days. Each year's days are
    summed by themselves and moved by the totals of the years before, which are a row a year.
    """
    moves = df.select(F.to_date(first).alias("day"), F.lit(1).alias("d")).unionByName(df.where(F.col(closed).isNotNull()).select(F.to_date(closed).alias("day"), F.lit(-1).alias("d")))
    per = moves.groupBy("day").agg(F.sum("d").alias("d")).unionByName(days.select("day", F.lit(0).cast("long").alias("d")))
    by_day = per.groupBy("day").agg(F.sum("d").alias("d")).withColumn("_year", F.coalesce(F.year("day"), F.lit(-(10**9))))
    before = Window.orderBy("_year").rowsBetween(Window.unboundedPreceding, -1)
    years = by_day.groupBy("_year").agg(F.sum("d").alias("d")).select("_year", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("_before"))
    sums = by_day.join(F.broadcast(years), "_year").withColumn("active", F.sum("d").over(Window.partitionBy("_year").orderBy("day")) + F.col("_before"))
    return sums.join(days.select("day"), "day", "left_semi").select("day", "active")


def manifest_inclusion(records: DataFrame, cutoff: str) -> DataFrame:
    """`records` with included and reason; what is left out stays with its reason."""
    late = F.col("collected_at") > end_of_day(F.lit(cutoff))
    reason = F.when(late, "EXCLUDED_AFTER_ANALYSIS_CUTOFF").when(F.col("health") != "healthy", F.concat(F.lit("EXCLUDED_COLLECTION_"), F.upper("health"))).otherwise("INCLUDED")
    return records.withColumn("reason", reason).withColumn("included", F.col("reason") == "INCLUDED")


def source_availability(manifest: DataFrame, by: Sequence[str]) -> DataFrame:
    """AVAILABLE with an included record, FAILED with failed ones only, NO_HISTORY with late ones only, else UNAVAILABLE."""
    n = lambda c: F.count(F.when(c, 1))
    sums = manifest.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), n(F.col("included")).alias("included"), n(F.col("reason").startswith("EXCLUDED_COLLECTION")).alias("failed"), n(F.col("reason") == "EXCLUDED_AFTER_ANALYSIS_CUTOFF").alias("late"))
    return sums.withColumn("availability", F.when(F.col("included") > 0, "AVAILABLE").when(F.col("failed") > 0, "FAILED").when(F.col("late") > 0, "NO_HISTORY").otherwise("UNAVAILABLE"))


def due(sources: DataFrame, state: DataFrame, now: str, keys: Sequence[str]) -> DataFrame:
    """Sources without a state, without a next time, or whose next time has come."""
    joined = sources.join(state.select(*keys, "next_eligible_at"), list(keys), "left")
    return joined.withColumn("due", F.col("next_eligible_at").isNull() | (F.lit(now).cast("timestamp") >= F.col("next_eligible_at")))


def blind(df: DataFrame, allowed: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """The allowed columns; a forbidden one among them or missing ones are errors."""
    if leaked := sorted(set(allowed) & set(forbidden)):
        raise ValueError(f"forbidden columns: {leaked}")
    if missing := sorted(set(allowed) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*allowed)


def search(df: DataFrame, term: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose fields, joined by spaces, contain the term in any case; all rows for an empty term."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(term.strip().lower()))) if term.strip() else df


def watchlist(companies: DataFrame, health: str | None = None, with_careers: bool = False, with_observations: bool = False, changed_days: int | None = None, order: str = "name") -> DataFrame:
    """Companies by careers, observations, health and change within days of the latest change in the set, sorted.

    Orders: name, -name, changed, -changed, observations, -observations; ties by company_id.
    """
    out = companies
    if with_careers:
        out = out.where("has_careers")
    if with_observations:
        out = out.where("observations > 0")
    if health:
        out = out.where(F.col("health") == health)
    if changed_days is not None:
        latest = companies.agg(F.max("changed").alias("_latest"))
        out = out.crossJoin(F.broadcast(latest)).where(F.datediff("_latest", "changed") <= changed_days).drop("_latest")
    column = F.col(order.lstrip("-"))
    return out.orderBy(column.desc_nulls_last() if order.startswith("-") else column.asc_nulls_last(), "company_id")


def availability_date(df: DataFrame) -> DataFrame:
    """available_on and its basis: an override, else the latest approval date in a plausible year up to the cutoff,
    else the file's creation date up to the cutoff, else none (B11)."""
    fits = F.filter("approval_dates", lambda d: (F.abs(F.year(d) - F.col("report_year")) <= 1) & (d <= F.col("cutoff")))
    created = F.when(F.col("created_on") <= F.col("cutoff"), F.col("created_on"))
    approved = F.array_max(fits)
    basis = F.when(F.col("override_on").isNotNull(), "override").when(approved.isNotNull(), "approval_date").when(created.isNotNull(), "file_creation").otherwise("none")
    return df.withColumn("available_on", F.coalesce("override_on", approved, created)).withColumn("basis", basis)


def coverage_status(occasions: DataFrame, evidence: DataFrame, features: DataFrame, exclusions: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """One of six states of each occasion."""
    flag = lambda d, n: d.select(key).distinct().withColumn(n, F.lit(True))
    out = occasions
    for d, n in ((evidence, "_e"), (features, "_f"), (exclusions, "_x")):
        out = out.join(flag(d, n), key, "left")
    out = out.join(sources.select(key, F.col("status").alias("_s")).dropDuplicates([key]), key, "left")
    status = F.when(F.col("_x").isNotNull(), "EXCLUDED").when(F.col("_e").isNotNull() & F.col("_f").isNotNull(), "COMPLETE").when(F.col("_e").isNotNull(), "FEATURES_MISSING").when(F.col("_s") == "failed", "SOURCE_FAILED").when(F.col("_s").isNotNull(), "EVIDENCE_MISSING").otherwise("NO_SOURCE")
    return out.withColumn("status", status).drop("_e", "_f", "_x", "_s")


def completeness(required: DataFrame, covered: dict[str, DataFrame], key: str, by: str) -> DataFrame:
    """Per partition and kind: required, covered, missing ids in order."""
    out = None
    for kind, df in covered.items():
        have = df.select(key).distinct().withColumn("_c", F.lit(1))
        part = required.join(have, key, "left").groupBy(by).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("required"), F.count("_c").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("_c").isNull(), F.col(key)))).alias("missing"))
        out = part if out is None else out.unionByName(part)
    return out


def predictions_with_resolution(predictions: DataFrame, companies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Predictions of known companies with their resolution, if any."""
    return predictions.join(companies, "company_id").join(resolutions, "prediction_id", "left")


def resolve_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with the latest resolved outcome of company, target and window start.

    A company, target and window may have been resolved more than once; one row is kept, so that
    predictions do not multiply.
    """
    last = outcomes.where(F.col("status") == "resolved").groupBy("company_id", "target", "window_start").agg(F.max_by("outcome", "resolved_at").alias("outcome"), F.max("resolved_at").alias("resolved_at"))
    return predictions.withColumn("window_start", F.to_date("cutoff")).join(last, ["company_id", "target", "window_start"])


def evidence_contributions(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Linked evidence with its contribution and place by size of contribution."""
    order = Window.partitionBy("prediction_id").orderBy(F.abs("contribution").desc(), "evidence_id")
    return links.join(evidence, "evidence_id").withColumn("place", F.row_number().over(order))


def left_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every left row with the right columns where the keys meet (C4)."""
    return left.join(right, list(keys), "left")


def predictions_with_labels(predictions: DataFrame, labels: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Labelled predictions but uncertain ones, evidence text in order of evidence_id, positive lead days."""
    text = evidence.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "text"))), lambda x: x["text"]), "\n").alias("evidence_text"))
    joined = predictions.join(labels.where(F.col("label") != "uncertain"), key).join(text, key, "left")
    lead = F.datediff("event_date", "cutoff")
    return joined.withColumn("lead_days", F.when(lead > 0, lead))


#: Most days of a spine, which goes to all tasks.
MOST_DAYS = 100_000


def snapshots_as_of(rows: DataFrame, spine: DataFrame, keys: Sequence[str], value: str = "id") -> DataFrame:
    """For each as-of day: what arrived exactly then, and how many rows were available by then (E16). ValueError for a spine of more than MOST_DAYS days."""
    if spine.limit(MOST_DAYS + 1).count() > MOST_DAYS:
        raise ValueError(f"a spine has {MOST_DAYS} days at most")
    per = rows.groupBy(*keys, F.to_date("available_at").alias("as_of")).agg(F.array_sort(F.collect_list(value)).alias("arrived"), F.count(F.lit(1)).alias("n"))
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(spine.select("as_of")))
    dense = grid.join(per, [*keys, "as_of"], "full_outer")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*keys).orderBy("as_of"))
    return dense.select(*keys, "as_of", F.coalesce("arrived", F.array()).alias("arrived"), total.alias("available")).join(F.broadcast(spine.select("as_of")), "as_of", "left_semi")


def admissible_late(stream: DataFrame, cutoff: str, delay: str = "30 days") -> DataFrame:
    """Evidence collected after the cutoff counts if it was available before; works on streams."""
    kept = stream.withWatermark("collected_at", delay) if stream.isStreaming else stream
    return as_of(kept, cutoff).withColumn("late", F.col("collected_at") > end_of_day(F.lit(cutoff)))
