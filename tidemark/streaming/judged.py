"""The lifecycle over whole histories without state: snapshot health as a fixpoint, then a closed form.

A task holds a snapshot's row and an identity's sightings, but never the identities of a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import saved
from tidemark.streaming.lifecycle import DROP_FROM, DROP_SHARE, MISSES

#: The sightings of a snapshot with more than HOT, of the MOST_HOT largest such, are dealt over PARTS parts where they meet it.
HOT, MOST_HOT, PARTS = 100_000, 10_000, 16


def sightings(snapshots: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """keys, ts, ok, seen, parts of each snapshot, and keys, ts, identity, part of all it holds; rows of the same time are one snapshot.

    Saved tables are small on disk for their rows, so joins to them ask for a merge: none is broadcast by its size there.
    """
    held = saved(snapshots.select(*keys, "ts", F.explode("identities").alias("identity")).where("identity is not null").distinct())
    once = snapshots.groupBy(*keys, "ts").agg(F.coalesce(F.bool_and(F.coalesce("success", F.lit(False))), F.lit(False)).alias("ok"))
    counts = saved(held.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("seen")))
    hot = F.broadcast(saved(counts.where(F.col("seen") > HOT).orderBy(F.desc("seen"), *keys, "ts").limit(MOST_HOT).select(*keys, "ts", F.lit(PARTS).alias("parts"))))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("identity"), F.lit(PARTS))).cast("int")
    dealt = held.join(hot, [*keys, "ts"], "left").select(*keys, "ts", "identity", part.alias("part"))
    all_of = once.join(counts.hint("merge"), [*keys, "ts"], "left").join(hot, [*keys, "ts"], "left")
    return saved(all_of.withColumns({"seen": F.coalesce("seen", F.lit(0).cast("long")), "parts": F.coalesce("parts", F.lit(1))})), dealt


def _placed(judged: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, identity, i: each sighting in a sound snapshot with that snapshot's number among the sound ones."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))
    sound = judged.where("sound").select(*keys, "ts", number.alias("i"), "parts").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return held.join(sound.hint("merge"), [*keys, "ts", "part"]).select(*keys, "identity", "i")


def _judge(judged: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`judged` with `now`: whether each snapshot is sound, if `sound` tells which ones before it are.

    An identity seen in snapshot i is open until it is seen again or MISSES snapshots have passed, so the open ones before a
    snapshot are a running sum of those that begin and end.
    """
    following = F.lead("i").over(Window.partitionBy(*keys, "identity").orderBy("i"))
    spans = _placed(judged, held, keys).withColumn("_until", F.least(F.coalesce(following, F.col("i") + MISSES), F.col("i") + MISSES))
    steps = spans.select(*keys, F.explode(F.array(F.struct(F.col("i"), F.lit(1).alias("d")), F.struct(F.col("_until").alias("i"), F.lit(-1).alias("d")))).alias("s"))
    change = steps.groupBy(*keys, "s.i").agg(F.sum("s.d").alias("d"))
    by_time = Window.partitionBy(*keys).orderBy("ts")
    numbered = judged.withColumn("i", F.when(F.col("sound"), F.sum(F.col("sound").cast("int")).over(by_time).cast("int")))
    joined = numbered.join(change.hint("merge"), [*keys, "i"], "left")
    was_open = F.coalesce(F.sum("d").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dropped = (was_open >= DROP_FROM) & (F.col("seen") <= was_open * DROP_SHARE)
    return joined.withColumn("now", F.col("ok") & ~dropped).select(*judged.columns, "now")


def judged_snapshots(once: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ts, ok, seen, parts, sound: which snapshots count, as a fold over time would tell.

    At first all that succeeded count. Each round judges all snapshots by the ones that counted in the
    last, until none changes. A snapshot's verdict rests on those before it, so each round settles one
    more at least; sources without a change are settled and leave the rounds.
    """
    settled, current = [], once.withColumn("sound", F.col("ok"))
    while True:
        after = saved(_judge(current, held, keys))
        moved = after.where("now <> sound").select(*keys).distinct()
        if moved.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, after.drop("now")])
        moved = moved.hint("merge")
        settled.append(after.join(moved, list(keys), "left_anti").drop("now"))
        current = after.join(moved, list(keys), "left_semi").withColumn("sound", F.col("now")).drop("now")
        held = saved(held.join(moved, list(keys), "left_semi"))


def lifecycle_states(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows as `lifecycle_fold`, for sources of any size: keys, identity, status, misses, reopened.

    snapshots: keys, ts, success, identities array. Failed and suspicious snapshots change nothing. Rows
    with a null key, time or identity are left out; a null success is a failure; a null array holds none.
    """
    rows = snapshots.dropna(subset=[*keys, "ts"])
    once, held = sightings(rows, keys)
    judged = saved(judged_snapshots(once, held, keys))
    last = judged.where("sound").groupBy(*keys).agg(F.count(F.lit(1)).alias("_last"))
    gap = F.col("i") - F.lag("i").over(Window.partitionBy(*keys, "identity").orderBy("i"))
    per = _placed(judged, held, keys).withColumn("_g", gap).groupBy(*keys, "identity").agg(F.max("i").alias("_m"), F.count(F.when(F.col("_g") > MISSES, 1)).alias("reopened"))
    missed = F.col("_last") - F.col("_m")
    return per.join(last.hint("merge"), list(keys)).select(*keys, F.col("identity").cast("string").alias("identity"), F.when(missed >= MISSES, "closed").otherwise("open").alias("status"), F.least(missed, F.lit(MISSES)).cast("int").alias("misses"), F.col("reopened").cast("int").alias("reopened"))


def health(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ts, seen, health of each snapshot: healthy, fetch_failed or suspicious_drop."""
    once, held = sightings(snapshots.dropna(subset=[*keys, "ts"]), keys)
    verdict = F.when(~F.col("ok"), "fetch_failed").when(F.col("sound"), "healthy").otherwise("suspicious_drop")
    return judged_snapshots(once, held, keys).select(*keys, "ts", "seen", verdict.alias("health"))
