"""Deterministic samples, quotas and partitions by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn(seed: str, *keys: str) -> Column:
    """The place of a row in a sample: a hash of seed and keys."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)


def hash_stratified(df: DataFrame, strata: Sequence[str], keys: Sequence[str], quota: int, seed: str) -> DataFrame:
    """The first `quota` rows of each stratum by hash (I1). Only that many of each leave a task before the shuffle."""
    w = Window.partitionBy(*strata).orderBy(turn(seed, *keys), *keys)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)


def short_strata(df: DataFrame, strata: Sequence[str], least: int) -> DataFrame:
    """Strata with fewer rows than needed."""
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def assign_partitions(companies: DataFrame, cutoffs: Sequence[tuple[str, str]], key: str, used: DataFrame | None = None, skip: str | None = None) -> DataFrame:
    """A row per company and cutoff with its partition; companies used before miss the cutoff `skip`."""
    spine = F.array(*(F.struct(F.lit(c).alias("cutoff"), F.lit(p).alias("partition")) for c, p in cutoffs))
    out = companies.select(key, F.explode(spine).alias("s")).select(key, "s.*")
    if used is None or skip is None:
        return out
    seen = used.select(key).distinct().withColumn("_u", F.lit(True))
    return out.join(seen, key, "left").where(~((F.col("cutoff") == skip) & F.coalesce("_u", F.lit(False)))).drop("_u")


def hash_cap(df: DataFrame, group: Sequence[str], keys: Sequence[str], cap: int, seed: str) -> DataFrame:
    """One row per key, then the first `cap` of each group by hash."""
    return hash_stratified(df.dropDuplicates([*group, *keys]), group, keys, cap, seed)


def balanced(df: DataFrame, family: str, label: str, quotas: dict[str, int], order: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to the quota of each family and label in order, and the quotas that fall short (I4)."""
    w = Window.partitionBy(family, label).orderBy(order)
    quota = F.try_element_at(F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v)))), F.col(label))
    kept = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)
    labels = df.sparkSession.createDataFrame([(k, v) for k, v in quotas.items()], f"{label} string, quota int")
    wanted = df.select(family).distinct().crossJoin(F.broadcast(labels))
    have = kept.groupBy(family, label).agg(F.count(F.lit(1)).alias("n"))
    short = wanted.join(have, [family, label], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < F.col("quota"))
    return kept, short


def priority_slice(df: DataFrame, family: str, priority: Sequence[Column], sure: int = 4, most: int = 6, size: int = 36) -> DataFrame:
    """The `sure` first rows of each family, then by priority up to `most` of a family and `size` in all."""
    place = F.row_number().over(Window.partitionBy(family).orderBy(*priority))
    ranked = df.withColumn("family_place", place).where(F.col("family_place") <= most)
    return ranked.orderBy(F.when(F.col("family_place") <= sure, 0).otherwise(1), *priority).limit(size)


def shuffled(df: DataFrame, seed: str, key: str) -> DataFrame:
    """Rows in an order by hash of seed and key."""
    return df.orderBy(turn(seed, key), key)


def per_group_cap(df: DataFrame, group: str, order: Sequence[str], cap: int) -> DataFrame:
    """The first `cap` rows of each group in order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= cap)


def union_mapped(sources: Sequence[tuple[DataFrame, dict[str, str], dict[str, str]]], fields: Sequence[str]) -> DataFrame:
    """Tables with other names and labels under one schema (I9): (table, column names, label map) each."""
    out = None
    for df, names, labels in sources:
        columns = [F.col(names[c]).cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in fields]
        part = df.select(*columns)
        if labels:
            part = part.withColumn("label", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.col("label")), F.col("label")))
        out = part if out is None else out.unionByName(part)
    return out


def keys_in_both(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def keys_only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b has not."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def paired_documents(df: DataFrame, tickers: int = 15) -> DataFrame:
    """Of the first tickers: the first annual document and the first other (else the last annual), workflow by turns."""
    first = df.select("ticker").distinct().orderBy("ticker").limit(tickers).withColumn("position", F.row_number().over(Window.orderBy("ticker")))
    rows = df.join(F.broadcast(first), "ticker")
    up = F.row_number().over(Window.partitionBy("ticker", "annual").orderBy("published", "document"))
    down = F.row_number().over(Window.partitionBy("ticker", "annual").orderBy(F.desc("published"), F.desc("document")))
    other = F.max((~F.col("annual")).cast("int")).over(Window.partitionBy("ticker"))
    r = rows.withColumn("_u", up).withColumn("_d", down).withColumn("_o", other)
    kept = r.where((F.col("annual") & (F.col("_u") == 1)) | (~F.col("annual") & (F.col("_u") == 1)) | (F.col("annual") & (F.col("_o") == 0) & (F.col("_d") == 1)))
    return kept.withColumn("workflow", F.when(F.col("position") % 2 == 1, "A").otherwise("B")).drop("_u", "_d", "_o")


def regression_cases(candidates: DataFrame, labels: DataFrame, written: DataFrame) -> DataFrame:
    """Labelled candidates that are not supported, and written cases, under one schema.

    Labels meet candidates by an index column, never by the order of files.
    """
    labelled = candidates.join(labels, "row_index").where(F.col("label") != "supported").select("case_id", "text", "label", F.lit("labelled").alias("origin"))
    return labelled.unionByName(written.select("case_id", "text", "label", F.lit("written").alias("origin")))
