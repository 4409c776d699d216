"""Corroboration and qualification of operational conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.longitudinal import history_context, ordered_values, persistence_status

# Snapshots, consistent intervals and relative change that each family of conditions needs.
POLICY = {
    "hiring_expansion": (4, 3, 0.10),
    "hiring_contraction": (4, 3, 0.10),
    "workforce_functional_mix_shift": (4, 2, 0.10),
    "procurement_activity_acceleration": (4, 2, 0.25),
    "procurement_category_concentration_change": (4, 2, 0.15),
}


def corroboration(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Families, observations, derivative duplicates and status of each candidate.

    df has observation_id, source_family, derivative_group (null: none), contradicts. A single
    observation is DUPLICATE_ONLY: it has n - 1 = 0 duplicates.
    """
    group = F.coalesce(F.col("derivative_group").cast("string"), F.col("observation_id").cast("string"))
    per = df.groupBy(*by, group.alias("_g")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("source_family").alias("f"), F.bool_or("contradicts").alias("x"))
    sums = per.groupBy(*by).agg(F.sum("n").alias("observations"), F.sum(F.col("n") - 1).alias("duplicates"), F.size(F.array_distinct(F.flatten(F.collect_set("f")))).alias("families"), F.bool_or("x").alias("contradicted"))
    status = F.when(F.col("contradicted"), "CONTRADICTORY").when(F.col("duplicates") == F.col("observations") - 1, "DUPLICATE_ONLY").when(F.col("families") > 1, "INDEPENDENT").when(F.col("observations") > 1, "MULTIPLE_OBSERVATIONS_ONE_FAMILY").otherwise("REPEATED_WITHIN_SOURCE")
    return sums.select(*by, "observations", "duplicates", "families", status.alias("status"))


def hiring_candidates(snapshots: DataFrame, by: Sequence[str], cutoff: str, ts: str = "ts", count: str = "open_count") -> DataFrame:
    """Candidates from healthy snapshots up to the cutoff, of groups with two or more."""
    rows = snapshots.where((F.to_date(ts) <= F.lit(cutoff).cast("date")) & F.col("healthy"))
    values = ordered_values(rows, by, ts, count).where(F.size("values") >= 2)
    first, last = F.get("values", F.lit(0)), F.element_at("values", -1)
    base = values.select(*by, first.alias("first"), last.alias("last"))
    status = persistence_status(rows, by, ts, count)
    history = history_context(rows, by, ts).select(*by, "consistent", "depth")
    change = F.col("last") - F.col("first")
    out = base.join(status, list(by)).join(history, list(by))
    moved = F.size(F.filter("changes", lambda x: x != 0))
    return out.select(
        *by,
        F.when(change > 0, "hiring_expansion").when(change < 0, "hiring_contraction").alias("candidate_type"),
        "snapshots",
        change.alias("absolute_change"),
        F.try_divide(change, F.col("first")).alias("relative_change"),
        "persistence",
        "contradiction",
        F.when(F.col("contradiction"), 0).otherwise(moved).alias("consistent_intervals"),
        "consistent",
        "depth",
        F.col("first").alias("denominator"),
    )


def procurement_candidates(records: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Candidates of approved entities with two or more months on record and more in the last than in the first."""
    months = records.where("approved").groupBy(*by, F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    values = ordered_values(months, by, "month", "n").where(F.size("values") >= 2)
    first, last = F.get("values", F.lit(0)), F.element_at("values", -1)
    return values.where(last > first).select(*by, F.lit("procurement_activity_acceleration").alias("candidate_type"), F.size("values").alias("months"), (last - first).alias("absolute_change"), ((last - first) / first).alias("relative_change"))


def qualify(candidates: DataFrame, policy: dict[str, tuple] | None = None) -> DataFrame:
    """`candidates` with failed (names of required tests not met) and status.

    Without a policy the status is WITHHELD. direction and materiality are told only when qualified.
    Optional columns references_ok, duplicate_only, scope_ok, healthy and mechanism are taken as met when
    they are not there.
    """
    policy = policy or POLICY
    have = lambda c: F.col(c) if c in candidates.columns else F.lit(True)
    part = lambda i: F.try_element_at(F.create_map(*(x for k, v in policy.items() for x in (F.lit(k), F.lit(v[i])))), F.col("candidate_type"))
    tests = {
        "references": have("references_ok"),
        "duplicate_evidence": ~F.col("duplicate_only") if "duplicate_only" in candidates.columns else F.lit(True),
        "entity_scope": have("scope_ok"),
        "source_health": have("healthy"),
        "history_depth": F.col("snapshots") >= part(0),
        "denominator": F.col("denominator") > 0,
        "magnitude": F.abs("relative_change") >= part(2),
        "persistence": F.col("consistent_intervals") >= part(1),
        "contradiction": ~F.col("contradiction"),
        "operational_mechanism": have("mechanism"),
    }
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items())))
    out = candidates.withColumn("failed", failed)
    good = F.size("failed") == 0
    out = out.withColumn("status", F.when(part(0).isNull(), "WITHHELD").when(good, "QUALIFIED").otherwise("INSUFFICIENT_EVIDENCE"))
    told = F.col("status") == "QUALIFIED"
    return out.withColumn("direction", F.when(told, F.when(F.col("relative_change") > 0, "INCREASING").otherwise("DECREASING")).otherwise("UNKNOWN")).withColumn("materiality", F.when(told, "LOW").otherwise("UNKNOWN"))


def peer_percentile(df: DataFrame, cohort: str, key: str, value: str) -> DataFrame:
    """The share of the other members of the cohort with a lower value, ties as half.

    Null under 20 members; caution under 30, acceptable under 50, preferred from 50 on. Null values take no
    part and are never zero. Ranks come from counts of distinct values, so ties never pair up.
    """
    rows = df.where(F.col(value).isNotNull())
    per = rows.groupBy(cohort, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(cohort).orderBy("v")
    per = per.withColumn("below", F.sum("n").over(up) - F.col("n"))
    size = per.groupBy(cohort).agg(F.sum("n").alias("members"))
    joined = rows.select(key, cohort, F.col(value).alias("v")).join(per, [cohort, "v"]).join(size, cohort)
    share = (F.col("below") + (F.col("n") - 1) / 2) / (F.col("members") - 1)
    label = F.when(F.col("members") < 20, "suppressed").when(F.col("members") < 30, "caution").when(F.col("members") < 50, "acceptable").otherwise("preferred")
    return joined.select(key, cohort, "members", label.alias("reliability"), F.when(F.col("members") >= 20, share).alias("percentile"))
