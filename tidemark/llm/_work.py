"""Tables written between jobs, joins on hot keys, and connected components by joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more than HOT rows are hot, MOST_HOT of them at most; a hot key is dealt over PARTS parts.
HOT, MOST_HOT, PARTS = 1000, 10_000, 64


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder of spark.checkpoint.dir and read again, which cuts its lineage.

    Where the setting is missing, a local session, which is one process, takes a temporary folder; any
    other raises ValueError, as no folder is known to be shared.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: Sequence[str]) -> str:
    """`name`, or with so many underscores that no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """The MOST_HOT largest keys of `counts` (key, n) with more than HOT rows.

    Any other key has HOT rows or less, or less than 1 / MOST_HOT of all.
    """
    return saved(counts.where(F.col(key).isNotNull() & (F.col("n") > HOT)).orderBy(F.desc("n"), key).limit(MOST_HOT).select(key))


def counted(df: DataFrame, key: str) -> DataFrame:
    """key, n: the rows of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def hot_join(left: DataFrame, right: DataFrame, key: str, by: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """left.join(right, key, how) where a key may hold a third of left's rows.

    Rows of left with a key in `hot` (MOST_HOT rows at most, so it is broadcast) are dealt over PARTS
    parts by a hash of the columns `by`; the rows of right with that key are copied to each part.
    """
    parts = F.broadcast(hot.select(key, F.lit(PARTS).cast("long").alias("_parts")))
    many = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = left.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), many)).drop("_parts")
    copied = right.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges a-b (longs); nodes without an edge are left out.

    Each round takes the smallest label of the neighbours, then the label of the label, so that the
    rounds grow as the logarithm of the longest path. Labels are aggregated before each shuffle; no row
    holds a node's neighbours, and nodes with many edges or many nodes below them are dealt over parts.
    """
    both = saved(edges.select("a", F.col("b").alias("node")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("node"))).distinct())
    hubs = hot_keys(counted(both, "node"), "node")
    labels = saved(both.groupBy("a").agg(F.min("node").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")))
    while True:
        near = hot_join(both, labels, "node", ["a"], hubs).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = saved(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("root")))
        roots = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        crowns = hot_keys(counted(hooked, "root"), "root")
        after = saved(hot_join(hooked, roots, "root", ["node"], crowns, "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("comp")))
        labels = after.select("node", "comp")
        if after.where(F.col("comp") != F.col("old")).isEmpty():
            return labels
