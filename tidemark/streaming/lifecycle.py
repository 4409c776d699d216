"""Lifecycle of postings over snapshots, as a batch and as a stream with one state function."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.tables import _files, _put_text

#: Healthy snapshots in a row without an identity that close it.
MISSES = 2
#: A snapshot is suspicious if it has at most this share of at least so many open identities.
DROP_SHARE, DROP_FROM = 0.2, 10
CADENCE_HOURS = 48


def fold(state: dict, source: dict, identities: set, success: bool) -> tuple[str, dict]:
    """Applies one snapshot to `state` (identity to [status, misses, reopened, first, last]) and `source`; returns its health and counts.

    A failed or suspicious snapshot changes no identity. `source` has failures; `state` and `source` are
    changed in place.
    """
    was_open = sum(v[0] == "open" for v in state.values())
    suspicious = success and was_open >= DROP_FROM and len(identities) <= was_open * DROP_SHARE
    health = "fetch_failed" if not success else "suspicious_drop" if suspicious else "healthy"
    n = dict.fromkeys(("new", "persistent", "reopened", "closed", "absent_once"), 0)
    if health != "healthy":
        source["failures"] = source.get("failures", 0) + 1
        return health, n
    source["failures"] = 0
    for i in identities:
        if i not in state:
            state[i] = ["open", 0, 0]
            n["new"] += 1
        elif state[i][0] == "closed":
            state[i] = ["open", 0, state[i][2] + 1]
            n["reopened"] += 1
        else:
            state[i][1] = 0
            n["persistent"] += 1
    for i, v in state.items():
        if v[0] == "open" and i not in identities:
            v[1] += 1
            if v[1] >= MISSES:
                v[0] = "closed"
                n["closed"] += 1
            else:
                n["absent_once"] += 1
    return health, n


def backoff(failures: int) -> int:
    """Hours to wait: 24, 48, 96, then 168; 0 after a healthy snapshot."""
    return min(24 * 2 ** min(failures - 1, 8), 168) if failures else 0


def lifecycle_fold(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, identity, status, misses, reopened after all snapshots, folded in time order.

    snapshots: keys, ts, success, identities array. Rows of the same time are one snapshot. A key's
    history is held by one task: it is one source's snapshots.
    """
    once = snapshots.groupBy(*keys, "ts").agg(F.bool_and("success").alias("success"), F.array_distinct(F.flatten(F.collect_list("identities"))).alias("identities"))
    schema = ", ".join([*(f"{k} {dict(snapshots.dtypes)[k]}" for k in keys), "identity string, status string, misses int, reopened int"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        source: dict = {}
        for success, identities in group.sort_values("ts")[["success", "identities"]].itertuples(index=False):
            fold(state, source, set(identities), bool(success))
        head = [group[k].iloc[0] for k in keys]
        return pd.DataFrame([(*head, i, *v) for i, v in state.items()], columns=[*keys, "identity", "status", "misses", "reopened"])

    return once.groupBy(*keys).applyInPandas(run, schema)


def lifecycle_closed_form(seen: DataFrame, snapshots: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """The same as `lifecycle_fold` where every snapshot is healthy, without state.

    An identity is closed if MISSES snapshots follow its last; a gap of more than MISSES snapshots is a reopening.
    """
    numbered = snapshots.select(*keys, "ts").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")))
    last = numbered.groupBy(*keys).agg(F.max("_i").alias("_last"))
    at = seen.select(*keys, identity, "ts").distinct().join(numbered, [*keys, "ts"])
    gap = F.col("_i") - F.lag("_i").over(Window.partitionBy(*keys, identity).orderBy("_i"))
    per = at.withColumn("_g", gap).groupBy(*keys, identity).agg(F.max("_i").alias("_m"), F.count(F.when(F.col("_g") > MISSES, 1)).alias("reopened"))
    missed = F.least(F.col("_last") - F.col("_m"), F.lit(MISSES)).cast("int")
    return per.join(last, list(keys)).select(*keys, identity, F.when(F.col("_last") - F.col("_m") >= MISSES, "closed").otherwise("open").alias("status"), missed.alias("misses"), F.col("reopened").cast("int").alias("reopened"))


class Lifecycle(StatefulProcessor):
    """The stream form: keyed by source, one row of output for each snapshot.

    With `due` a source has one event-time timer, at its next time; if it passes without a snapshot, a
    row with the health `due` tells so.
    """

    def __init__(self, due: bool = False):
        self.due = due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "identity string", "status string, misses int, reopened int")
        self.source = handle.getValueState("source", "failures int, last_success timestamp, last_ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows))
        state = {k[0]: list(v) for k, v in self.jobs.iterator()} if self.jobs.exists() else {}
        before = {i: tuple(v) for i, v in state.items()}
        kept = self.source.get() if self.source.exists() else None
        source = {"failures": kept[0] if kept else 0}
        success_at, seen_to = (kept[1], kept[2]) if kept else (None, None)
        out = []
        for ts, group in table.sort_values("ts").groupby("ts"):
            if seen_to is not None and ts <= pd.Timestamp(seen_to):
                out.append((*key, ts, "late", len({i for ids in group["identities"] for i in ids}), 0, 0, 0, 0, 0, source["failures"], backoff(source["failures"]), None))
                continue
            seen_to = ts
            identities = {i for ids in group["identities"] for i in ids}
            health, n = fold(state, source, identities, bool(group["success"].all()))
            success_at = ts if health == "healthy" else success_at
            wait = backoff(source["failures"])
            out.append((*key, ts, health, len(identities), *n.values(), source["failures"], wait, ts + pd.Timedelta(hours=max(CADENCE_HOURS, wait))))
        for i, v in state.items():
            if before.get(i) != tuple(v):
                self.jobs.updateValue((i,), tuple(v))
        if seen_to is not None:
            self.source.update((source["failures"], None if success_at is None else pd.Timestamp(success_at).to_pydatetime(), pd.Timestamp(seen_to).to_pydatetime()))
        if self.due and out and out[-1][-1] is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(out[-1][-1].timestamp() * 1000))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        failures = self.source.get()[0] if self.source.exists() else 0
        yield pd.DataFrame([(*key, at, "due", 0, 0, 0, 0, 0, 0, failures, backoff(failures), at)], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["source", "ts", "health", "seen", "new", "persistent", "reopened", "closed", "absent_once", "failures", "backoff_hours", "next_eligible_at"]
SCHEMA = "source string, ts timestamp, health string, seen int, new int, persistent int, reopened int, closed int, absent_once int, failures int, backoff_hours int, next_eligible_at timestamp"


def lifecycle_stream(snapshots: DataFrame, due: str | None = None) -> DataFrame:
    """A stream of (source, ts, success, identities) as a stream of snapshot results.

    Snapshots at or before the last one of a source change nothing and are told as `late`. With `due`, a
    delay such as "1 hour", the watermark of `ts` runs so far behind the latest snapshot of all sources; when it passes a
    source's next time, the source is told as `due` without a row of its own. Needs the RocksDB state
    store. Only identities that changed are written to the state.
    """
    if due is None:
        return snapshots.groupBy("source").transformWithStateInPandas(Lifecycle(), SCHEMA, "append", "none")
    return snapshots.withWatermark("ts", due).groupBy("source").transformWithStateInPandas(Lifecycle(True), SCHEMA, "append", "EventTime")


def source_states(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """failures in a row, backoff, last success and next time of each source, from snapshots with health."""
    last_ok = F.max(F.when(F.col("health") == "healthy", F.col("ts"))).over(Window.partitionBy(*keys))
    rows = snapshots.withColumn("_ok", last_ok)
    per = rows.groupBy(*keys).agg(F.max("_ok").alias("last_success"), F.max("ts").alias("latest"), F.count(F.when(F.col("_ok").isNull() | (F.col("ts") > F.col("_ok")), 1)).cast("int").alias("failures"))
    wait = F.when(F.col("failures") == 0, 0).otherwise(F.least(24 * F.pow(F.lit(2), F.least(F.col("failures") - 1, F.lit(8))), F.lit(168)).cast("int"))
    return per.withColumn("backoff_hours", wait).withColumn("next_eligible_at", F.col("latest") + F.make_interval(hours=F.greatest(F.lit(CADENCE_HOURS), F.col("backoff_hours"))))


def presence_upsert(state: DataFrame, present: DataFrame, keys: Sequence[str], now: str) -> DataFrame:
    """The earlier rule: present is open, absent once is closed at `now`."""
    seen = present.select(*keys).distinct().withColumn("_p", F.lit(True))
    at = F.lit(now).cast("timestamp")
    j = state.join(seen, list(keys), "full_outer")
    return j.select(*keys, F.coalesce("first_seen", at).alias("first_seen"), F.when(F.col("_p"), at).otherwise(F.col("last_seen")).alias("last_seen"), F.when(F.col("_p"), None).otherwise(F.coalesce("closed_at", at)).alias("closed_at"))


#: A snapshot with so few of the jobs that were open is taken for an outage where at least LEAST_OPEN were.
OUTAGE_DROP, LEAST_OPEN = 0.8, 5


def job_states(previous: DataFrame, observed: DataFrame, keys: Sequence[str], success: bool = True) -> DataFrame:
    """keys, identity, title, location, status, misses, repost_of, healthy after one more snapshot of each key.

    previous: with status and misses; observed: keys, identity, title, location. A failed or suspiciously
    small snapshot changes nothing. Observed jobs are open; open ones that are missed MISSES times are
    closed; a new job with the title and location of a closed one reposts it.
    """
    counts = previous.where("status = 'open'").groupBy(*keys).agg(F.count(F.lit(1)).alias("_open")).join(observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen")), list(keys), "full_outer")
    drop = 1 - F.coalesce("_seen", F.lit(0)) / F.col("_open")
    healthy = F.lit(success) & ~F.coalesce((F.col("_open") >= LEAST_OPEN) & (drop >= OUTAGE_DROP), F.lit(False))
    health = counts.select(*keys, healthy.alias("healthy"))
    now = observed.select(*keys, "identity", F.col("title").alias("_title"), F.col("location").alias("_location"), F.lit(True).alias("_now"))
    j = previous.join(now, [*keys, "identity"], "full_outer").join(health, list(keys), "left").where(F.coalesce("healthy", F.lit(success)) | F.col("status").isNotNull())
    sound, seen, old = F.coalesce("healthy", F.lit(success)), F.coalesce("_now", F.lit(False)), F.col("status")
    misses = F.when(~sound, F.col("misses")).when(seen, 0).when(old == "open", F.col("misses") + 1).otherwise(F.col("misses"))
    status = F.when(~sound, old).when(seen, "open").when((old == "open") & (F.col("misses") + 1 >= MISSES), "closed").otherwise(old)
    at = lambda c: F.when(sound & seen, F.col(f"_{c}")).otherwise(F.col(c))
    states = j.select(*keys, "identity", at("title").alias("title"), at("location").alias("location"), status.alias("status"), misses.cast("int").alias("misses"), sound.alias("healthy"), (old.isNull()).alias("_new"))
    plain = F.trim(F.regexp_replace(F.lower("title"), r"\W+", " "))
    place = F.trim(F.regexp_replace(F.regexp_replace("location", "[–—]", "-"), r"\s+", " "))
    signed = states.withColumn("_t", plain).withColumn("_l", F.coalesce(F.lower(place), F.lit("")))
    closed = signed.where("status = 'closed'").groupBy(*keys, "_t", "_l").agg(F.max("identity").alias("_id"))
    return signed.join(closed, [*keys, "_t", "_l"], "left").withColumn("repost_of", F.when(F.col("_new"), F.col("_id"))).select(*keys, "identity", "title", "location", "status", "misses", "repost_of", "healthy")


def ingest(stream: DataFrame, keys: Sequence[str], digest: str, ts: str, delay: str = "7 days") -> DataFrame:
    """Each (keys, hash) once within the watermark, of a stream or a table."""
    if stream.isStreaming:
        return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, digest])
    return stream.dropDuplicates([*keys, digest])


def append_versions(store: DataFrame, new: DataFrame, keys: Sequence[str], digest: str, ts: str) -> DataFrame:
    """New rows whose hash is not their key's current one, numbered on from the store's versions; for foreachBatch."""
    current = store.groupBy(*keys).agg(F.max("version").alias("_v"), F.max_by(digest, "version").alias("_h"))
    w = Window.partitionBy(*keys).orderBy(ts, digest)
    j = new.join(current, list(keys), "left")
    before = F.coalesce(F.lag(digest).over(w), F.col("_h"))
    changed = j.withColumn("_c", (~before.eqNullSafe(F.col(digest))).cast("int"))
    return changed.withColumn("version", (F.coalesce("_v", F.lit(0)) + F.sum("_c").over(w)).cast("int")).where("_c = 1").drop("_v", "_h", "_c")


def ingest_sink(path: str, keys: Sequence[str], digest: str, ts: str, review: Column | None = None, named: Sequence[str] = ()):
    """A function for foreachBatch that adds the versions of a batch, and its review queue, to the store at `path`, once.

    Each batch has folders of its own and is judged by the batches before it; a log has the batches that are
    whole. A batch that is run again after it was logged does nothing; one that broke off writes the same
    folders again. So no version is added twice, wherever a run stops. Rows where `review` holds go to the
    queue by a hash of the keys and the columns `named`, as pending; those in it already are passed over.
    Versions are read by the batch's keys, with no more columns than these, the hash and the number.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in _logged(spark, path):
            return
        batch = batch.persist()
        try:
            old = _batches(spark, path, "versions", number)
            if old is None:
                old = batch.limit(0).withColumn("version", F.lit(0))
            known = old.select(*keys, digest, "version").join(batch.select(*keys).distinct(), list(keys), "left_semi")
            append_versions(known, batch, keys, digest, ts).write.mode("overwrite").parquet(f"{path}/versions/batch={number}")
            if review is not None:
                queue_id = F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys, *named])), 256), 1, 24)
                queued = batch.where(review).select(queue_id.alias("queue_id"), *keys, *named, F.lit("pending").alias("status")).dropDuplicates(["queue_id"])
                before = _batches(spark, path, "queue", number)
                if before is not None:
                    queued = queued.join(before.select("queue_id"), "queue_id", "left_anti")
                queued.write.mode("overwrite").parquet(f"{path}/queue/batch={number}")
        finally:
            batch.unpersist()
        _put_text(spark, f"{path}/log/{number}", "")

    return add


def _logged(spark: SparkSession, path: str) -> set[int]:
    """The numbers of the batches that are whole: one file name each."""
    files, hadoop = _files(spark, path)
    folder = hadoop.Path(f"{path}/log")
    if not files.util().exists(folder):
        return set()
    return {int(f.getPath().getName()) for f in files.util().listStatus(folder) if f.getPath().getName().isdigit()}


def _batches(spark: SparkSession, path: str, table: str, before: int | None = None) -> DataFrame | None:
    """The rows of whole batches, or of those with a smaller number than `before`; None where there are none."""
    numbers = sorted(n for n in _logged(spark, path) if before is None or n < before)
    return spark.read.parquet(*(f"{path}/{table}/batch={n}" for n in numbers)) if numbers else None


def stored_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions that `ingest_sink` has added, of whole batches only."""
    return _batches(spark, path, "versions")


def review_queue(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that wait for a review (J6); `current_decisions` joins what was decided."""
    return _batches(spark, path, "queue")


def current_decisions(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Items with their latest decision, pending without one; decisions are a log that is only added to."""
    last = decisions.groupBy(key).agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"), F.max("decided_at").alias("decided_at"))
    return items.join(last, key, "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
