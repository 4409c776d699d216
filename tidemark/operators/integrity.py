"""Integrity: violations come back as rows, never as a stop at the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import row_hash, snapshot_hash


def check(df: DataFrame, rules: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """key, rule: each rule that a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


def evidence_rules() -> dict[str, Column]:
    """The rules of observations (K1)."""
    unit = lambda c: F.col(c).between(0, 1)
    return {
        "available_before_collected": F.col("available_at") <= F.col("collected_at"),
        "confidence_in_range": unit("confidence"),
        "span_not_blank": F.length(F.trim("span")) > 0,
        "status_known": F.col("status").isin("pending", "accepted", "rejected", "corrected"),
        "model_named": (F.col("method") != "llm") | F.col("model").isNotNull(),
        "correction_has_value": (F.col("status") != "corrected") | F.col("corrected_value").isNotNull(),
    }


def availability_rules() -> dict[str, Column]:
    """Available rows need values, method and evidence; others show no number and carry a reason (K8)."""
    on = F.col("availability") == "AVAILABLE"
    return {
        "available_has_value": ~on | (F.col("base").isNotNull() & F.col("method").isNotNull() & (F.size("evidence_ids") > 0)),
        "unavailable_has_no_value": on | (F.col("low").isNull() & F.col("base").isNull() & F.col("high").isNull()),
        "unavailable_has_reason": on | F.col("reason").isNotNull(),
        "ordered": ~on | (F.coalesce(F.col("low") <= F.col("base"), F.lit(True)) & F.coalesce(F.col("base") <= F.col("high"), F.lit(True))),
    }


def adjudication_rules(labels: Sequence[str] = ("positive", "negative", "uncertain")) -> dict[str, Column]:
    """Label known, adjudicator and time given; a positive has a date in its window and a source."""
    yes = F.col("label") == "positive"
    return {
        "label_known": F.col("label").isin(*labels),
        "adjudicated": F.col("adjudicator").isNotNull() & F.col("adjudicated_at").isNotNull(),
        "positive_has_source": ~yes | F.col("source").isNotNull(),
        "positive_in_window": ~yes | ((F.col("event_date") > F.col("cutoff")) & (F.col("event_date") <= F.col("window_end"))),
    }


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has (K2)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def leaks(evidence: DataFrame, occasions: DataFrame, key: str, clock: str = "available_at", cutoff: str = "cutoff") -> DataFrame:
    """Evidence that was not available at its occasion's cutoff (K3)."""
    return evidence.join(occasions.select(key, cutoff), key).where(F.col(clock) > F.col(cutoff))


def open_references(df: DataFrame, refs: str, known: DataFrame, key: str, owner: Sequence[str]) -> DataFrame:
    """References of array column `refs` that no row of `known` has (K4)."""
    each = df.select(*owner, F.explode(refs).alias(key))
    return each.join(known.select(key).distinct(), key, "left_anti").select(*owner, key)


def crossed_references(df: DataFrame, refs: str, known: DataFrame, key: str, occasion: str) -> DataFrame:
    """References to rows of another occasion (K4)."""
    each = df.select(F.col(occasion).alias("_o"), F.explode(refs).alias(key))
    return each.join(known.select(key, occasion), key).where(F.col("_o") != F.col(occasion))


def stale_hashes(df: DataFrame, columns: Sequence[str], stored: str, key: Sequence[str]) -> DataFrame:
    """Rows whose stored hash is not the hash of their values (K5)."""
    return df.withColumn("computed", row_hash(columns)).where(~F.col("computed").eqNullSafe(F.col(stored))).select(*key, stored, "computed")


def register(store: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and conflicts: the same key with other values, in the store or among the new.

    Appending the first only when the second is empty keeps the register immutable.
    """
    have = store.select(*keys, row_hash(values).alias("_old")).distinct()
    rows = new.withColumn("_new", row_hash(values)).dropDuplicates([*keys, "_new"])
    clash = rows.groupBy(*keys).agg(F.countDistinct("_new").alias("_n"))
    joined = rows.join(have, list(keys), "left").join(clash, list(keys))
    bad = (F.col("_n") > 1) | (F.col("_old").isNotNull() & (F.col("_old") != F.col("_new")))
    return joined.where(~bad & F.col("_old").isNull()).drop("_old", "_new", "_n"), joined.where(bad).drop("_old", "_new", "_n")


def prediction_records(scored: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Scored occasions with the hash of their evidence, the same in any order (K7)."""
    ids = evidence.groupBy(key).agg(F.collect_set(F.col("evidence_id").cast("string")).alias("_ids"))
    return scored.join(ids, key, "left").withColumn("evidence_hash", snapshot_hash(F.coalesce("_ids", F.array().cast("array<string>")))).drop("_ids")


def membership(answers: DataFrame, frozen: DataFrame, key: str, domains: dict[str, Sequence[str]]) -> DataFrame:
    """key, problem: answers missing, unexpected or repeated, outside a domain, or with a span not in the context (K9)."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a = answers.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in [*domains, "span"]))
    j = a.join(frozen.select(key, "context", F.lit(True).alias("_f")), key, "full_outer")
    tests = [
        F.when(F.col("_n").isNull(), "missing"),
        F.when(F.col("_f").isNull(), "unexpected"),
        F.when(F.col("_n") > 1, "repeated"),
        *(F.when(F.col("_n").isNotNull() & ~F.coalesce(F.col(c).isin(*v), F.lit(False)), f"domain:{c}") for c, v in domains.items()),
        F.when(F.col("span").isNotNull() & F.col("context").isNotNull() & ~F.contains(plain(F.col("context")), plain(F.col("span"))), "span"),
    ]
    return j.select(key, F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def undefined_features(features: DataFrame, types: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Feature ids without a definition: every type with every suffix is defined."""
    catalogue = types.select(F.explode(F.array(*(F.concat(F.col("event_type"), F.lit(f"_{s}")) for s in suffixes))).alias("feature_id"))
    return features.select("feature_id").distinct().join(catalogue.distinct(), "feature_id", "left_anti")


def provenance(df: DataFrame, key: str, arrays: Sequence[str]) -> DataFrame:
    """A row per position of the arrays, shorter ones filled with nulls."""
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("place", "z")).select(key, "place", *(F.col(f"z.{a}").alias(a) for a in arrays))


def diagnostics(df: DataFrame, keys: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """key, feature, value, contribution, direction: a row per prediction and feature."""
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (F.col(c) * w).cast("double").alias("contribution")) for c, w in weights.items()))
    out = df.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    return out.withColumn("direction", F.when(F.col("contribution") > 0, "raises").when(F.col("contribution") < 0, "lowers").otherwise("none"))


def role_violations(documents: DataFrame) -> DataFrame:
    """Prediction documents after the cutoff, outcome documents up to it, and rows that were not located."""
    late = (F.col("role") == "prediction") & (F.col("available_at") > F.col("cutoff"))
    early = (F.col("role") == "outcome") & (F.col("available_at") <= F.col("cutoff"))
    return documents.withColumn("violation", F.when(late, "after_cutoff").when(early, "before_cutoff").when(F.col("location").isNull(), "not_located")).where("violation is not null")


def freeze(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows, reviewers, unspanned, table_hash: what a frozen annotation table is checked by; the hash is the same in any order."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("reviewer").alias("reviewers"), F.count(F.when(F.col("span").isNull() | F.col("annotated_at").isNull(), 1)).alias("unspanned"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("table_hash"))


def artifact_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: files of the manifest that are missing or whose bytes have another hash."""
    j = manifest.join(files.select("path", F.sha2("content", 256).alias("_h")), "path", "left")
    return j.withColumn("problem", F.when(F.col("_h").isNull(), "missing").when(F.col("_h") != F.col("sha256"), "changed")).where("problem is not null").select("path", "problem")
