"""Sources, and the lifecycle as batch, closed form and stream."""

import json
import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import postings, tables
from tidemark.streaming import judged, lifecycle


def plain(rows):
    return sorted(tuple(r) for r in rows)


def test_csv_and_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"\nnext', 1)], "k string, v string, n int").coalesce(1)
    tables.write_csv(df, f"{tmp_path}/c", ["k", "v", "n"])
    assert tables.read_csv(spark, f"{tmp_path}/c", df.schema).collect() == df.collect()
    tables.write_jsonl(df, f"{tmp_path}/j")
    assert tables.read_jsonl(spark, f"{tmp_path}/j", df.schema).collect() == df.collect()
    _, twice = tables.read_batches(spark, f"{tmp_path}/c", df.schema, ["k"])
    assert twice.count() == 0


def test_csv_keeps_edges_and_reads_empty_as_null(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 1), ("b\n", 2), ("\tc", 3), ("", 4), (None, 5), ('"', 6), ("\\", 7), ("d\\\"e", 8), ("x" * 200_000, 9)], "k string, n int")
    tables.write_csv(df, f"{tmp_path}/e", ["k", "n"])
    assert sorted(tables.read_csv(spark, f"{tmp_path}/e", df.schema).collect(), key=lambda r: r.n) == [(r.k or None, r.n) for r in df.collect()]


def test_file_hashes(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert tables.file_hashes(spark, str(tmp_path)).first().sha256.startswith("ba7816bf")


def test_artifact_problems(spark, tmp_path):
    from tidemark.operators.integrity import artifact_problems

    for name, data in (("a", b"abc"), ("b", b"xyz")):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    hashes = [(r.path, r.sha256) for r in tables.file_hashes(spark, str(tmp_path)).collect()]
    manifest = spark.createDataFrame([*hashes, ("gone", "0")], "path string, sha256 string")
    assert artifact_problems(files, manifest).collect() == [("gone", "missing")]
    (tmp_path / "b").write_bytes(b"other")
    found = {(r.path.split("/")[-1], r.problem) for r in artifact_problems(spark.read.format("binaryFile").load(str(tmp_path)), manifest).collect()}
    assert found == {("b", "changed"), ("gone", "missing")}


def test_nested_write(spark, tmp_path):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    parts = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    tables.write_nested(tables.nested(keys, "k", {"parts": (parts, ["v"])}), f"{tmp_path}/n", "k")
    got = spark.read.schema("parts array<struct<v: string>>, k int").json(f"{tmp_path}/n")
    assert {r.k: [x.v for x in r.parts] for r in got.collect()} == {1: ["a", "b"], 2: []}


def test_feeds_have_one_schema(spark):
    data = [
        ("g", "greenhouse", {"jobs": [{"id": 1, "title": "A", "absolute_url": "u", "updated_at": "2024-01-02T03:04:05Z", "content": "&lt;p&gt;Hi&lt;/p&gt;", "location": {"name": "Leeds"}, "departments": [{"name": "X"}, {"name": "Y"}]}]}),
        ("l", "lever", [{"id": "q", "text": "B", "categories": {"team": "T"}, "description": "<b>d</b>", "createdAt": 0}]),
        ("a", "ashby", {"jobs": [{"title": "C", "jobUrl": "https://jobs.ashbyhq.com/co/abc/"}]}),
        ("s", "smartrecruiters", {"content": [{"id": "r", "name": "D", "location": {"city": "Paris", "country": "fr"}}]}),
        ("r", "recruitee", {"offers": [{"id": 5, "title": "E"}]}),
        ("z", "other", {}),
    ]
    df = spark.createDataFrame([(c, p, json.dumps(x)) for c, p, x in data], "company string, provider string, payload string")
    found, unknown = postings.union_feeds(df)
    got = {r.company: r for r in found.collect()}
    assert got["g"].department == "X, Y" and got["g"].description == "Hi" and got["g"].posted_at is not None
    assert got["l"].description == "d" and got["a"].external_id == "abc" and got["s"].location == "Paris, fr" and got["r"].external_id == "5"
    assert [r.company for r in unknown.collect()] == ["z"]


def test_provider_detection(spark):
    urls = {
        "https://boards.greenhouse.io/acme": ("greenhouse", "acme", True, "Documented public GET API"),
        "https://job-boards.greenhouse.io": ("greenhouse", None, True, "Documented public GET API"),
        "https://jobs.eu.lever.co/co/1": ("lever-eu", "co", True, "Documented public postings API"),
        "https://jobs.lever.co/co/1": ("lever", "co", True, "Documented public postings API"),
        "https://jobs.ashbyhq.com/co": ("ashby", "co", True, "Documented public job-board API"),
        "https://jobs.smartrecruiters.com/Co/7": ("smartrecruiters", "Co", True, "Public Posting API"),
        "https://acme.recruitee.com/": ("recruitee", "acme", True, "Public careers-site feed"),
        "https://co.wd3.myworkdayjobs.com/en/x": ("workday", "co", False, "No general documented public job-board API"),
        "https://apply.workable.com/co/": ("workable", "co", False, "Formal API requires customer credentials"),
        "https://co.workable.com/x": ("workable", None, False, "Formal API requires customer credentials"),
        "https://co.teamtailor.com": ("teamtailor", "co", False, "Public API requires an API key"),
        "https://careers-co.icims.com/jobs": ("icims", None, False, "Use public-page structured data where permitted"),
        "https://co.jobs.personio.de/job/1": ("personio", "co", False, "Use public XML/page feed only when exposed by the employer"),
        "https://career5.successfactors.eu/x": ("successfactors", None, False, "Enterprise API is authenticated"),
        "https://co.taleo.net/x": ("taleo", None, False, "Use public-page structured data where permitted"),
        "https://example.com/jobs": ("unknown", None, False, "Inspect for schema.org JobPosting data"),
        "no address": ("unknown", None, False, "Inspect for schema.org JobPosting data"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: tuple(r.p) for r in df.select("u", postings.detect_provider(F.col("u")).alias("p")).collect()} == urls


def test_jsonld(spark):
    graph = {"@graph": [{"@type": ["Thing", "JobPosting"], "title": "B", "identifier": {"value": "7"}, "jobLocation": {"address": {"addressLocality": "Leeds", "addressCountry": "GB"}}}, {"@type": "Org"}]}
    page = f'<script type="application/ld+json">{json.dumps([{"@type": "JobPosting", "title": "A"}])}</script><script type="application/ld+json">no json</script><script type="application/ld+json">{json.dumps(graph)}</script>'
    jobs = postings.jsonld_jobs(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"])
    got = {r.title: r for r in postings.jsonld_postings(jobs, ["id"]).collect()}
    assert set(got) == {"A", "B"} and got["A"].external_id.startswith("jsonld-") and (got["B"].external_id, got["B"].location) == ("7", "Leeds, GB")


def test_notices(spark):
    release = {"ocid": "o", "date": "2024-01-01", "tender": {"title": "T", "value": {"amount": 9.0, "currency": "GBP"}}, "parties": [{"id": "p", "name": "Party"}], "awards": [{"id": "a", "suppliers": [{"id": "p"}, {"id": "q", "name": "Q"}]}]}
    df = spark.createDataFrame([(json.dumps({"releases": [release, {"ocid": "n"}]}),)], "payload string")
    got = sorted(((r.ocid, r.supplier, r.amount) for r in postings.flatten_notices(df).collect()), key=str)
    assert got == sorted([("n", None, None), ("o", "Party", 9.0), ("o", "Q", 9.0)], key=str)


def test_filings(spark):
    p = {"form": ["10-K", "8-K", "10-K", "10-K"], "filingDate": ["2025-01-01", "2024-06-01", "2024-01-01", "2023-01-01"], "accessionNumber": list("abcd"), "primaryDocument": list("wxyz")}
    df = spark.createDataFrame([("1", json.dumps(p))], "cik string, payload string")
    assert sorted(r.accessionNumber for r in postings.select_filings(df, "cik", {"10-K": 1, "8-K": 1}, "2024-12-31").collect()) == ["b", "c"]


def history(seed, steps=30):
    rng = random.Random(seed)
    t, out = datetime(2024, 1, 1), []
    for k in range(steps):
        ids = [f"j{i}" for i in range(14) if rng.random() < 0.7]
        out.append((f"s{seed}", t + timedelta(days=k), rng.random() > 0.1, ids if k % 9 else ids[:1]))
    return out


def naive(rows):
    state, source, results = {}, {}, []
    for _, ts, ok, ids in rows:
        results.append((ts, *lifecycle.fold(state, source, set(ids), ok)))
    return state, results


def test_two_misses_close_and_bad_snapshots_change_nothing():
    state, source = {}, {}
    many = {f"j{i}" for i in range(12)}
    lifecycle.fold(state, source, many, True)
    assert lifecycle.fold(state, source, {"j0"}, True)[0] == "suspicious_drop"
    assert lifecycle.fold(state, source, set(), False)[0] == "fetch_failed" and source["failures"] == 2
    less = many - {"j0"}
    assert lifecycle.fold(state, source, less, True)[1]["absent_once"] == 1
    assert lifecycle.fold(state, source, less, True)[1]["closed"] == 1
    assert lifecycle.fold(state, source, many, True)[1]["reopened"] == 1
    assert [lifecycle.backoff(n) for n in range(5)] == [0, 24, 48, 96, 168]


SNAPSHOT = "source string, ts timestamp, success boolean, identities array<string>"


def test_fold_and_replay_are_the_naive_fold(spark, tmp_path):
    data = [history(s) for s in (1, 2)]
    df = spark.createDataFrame([r for d in data for r in d], SNAPSHOT)
    want = {(d[0][0], i): tuple(v) for d in data for i, v in naive(d)[0].items()}
    for store in (lifecycle.lifecycle_fold(df, ["source"]), tables.replay(df, ["source"], f"{tmp_path}/store")):
        assert {(r.source, r.identity): (r.status, r.misses, r.reopened) for r in store.collect()} == want


def steep_history(seed):
    """Snapshots of many identities with outages in a row, drops after drops and a slow decline."""
    rng = random.Random(seed)
    t, out, share = datetime(2024, 1, 1), [], 1.0
    for k in range(rng.randint(1, 60)):
        share = rng.choice([share, share, 1.0, 0.6, 0.15, 0.05, 0.0])
        ids = [f"j{i}" for i in range(rng.choice([9, 12, 40])) if rng.random() < share]
        out.append((f"s{seed}", t + timedelta(hours=k), rng.random() > 0.15, ids))
    return out


def test_fixpoint_is_the_fold(spark):
    data = [history(s) for s in (1, 2, 3)] + [steep_history(s) for s in range(10, 40)]
    extra = [("s1", datetime(2024, 1, 5), True, ["late", None, "late"]), ("s2", None, True, ["x"]), (None, datetime(2024, 1, 1), True, ["x"]), ("empty", datetime(2024, 1, 1), True, None), ("s10", datetime(2025, 1, 1), None, ["x"])]
    df = spark.createDataFrame([r for d in data for r in d] + extra, SNAPSHOT)
    merged = {}
    for s, ts, ok, ids in [r for d in data for r in d] + extra:
        if s is not None and ts is not None:
            have = merged.setdefault(s, {}).setdefault(ts, [True, set()])
            have[0], have[1] = have[0] and bool(ok), have[1] | {i for i in ids or [] if i is not None}
    want, verdicts = {}, {}
    for s, rows in merged.items():
        state, _, results = {}, {}, []
        source = {}
        for ts, (ok, ids) in sorted(rows.items()):
            verdicts[s, ts] = (lifecycle.fold(state, source, ids, ok)[0], len(ids))
        want |= {(s, i): tuple(v) for i, v in state.items()}
    assert {(r.source, r.identity): (r.status, r.misses, r.reopened) for r in judged.lifecycle_states(df, ["source"]).collect()} == want
    assert {(r.source, r.ts): (r.health, r.seen) for r in judged.health(df, ["source"]).collect()} == verdicts
    assert {"suspicious_drop", "fetch_failed", "healthy"} == {h for h, _ in verdicts.values()}
    assert judged.lifecycle_states(df.limit(0), ["source"]).count() == 0


def test_a_rebuild_that_fails_leaves_the_store(spark, tmp_path):
    df = spark.createDataFrame(history(1), SNAPSHOT)
    store = f"{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        tables.current(spark, store)
    first = plain(tables.replay(df, ["source"], store).collect())
    breaks = df.withColumn("identities", F.when(F.col("ts") > "2024-01-20", F.raise_error(F.lit("half way")).cast("array<string>")).otherwise(F.col("identities")))
    with pytest.raises(Exception, match="half way"):
        tables.replay(breaks, ["source"], store)
    with pytest.raises(Exception, match="half way"):
        tables.publish(breaks.select(F.explode("identities")), store)
    assert plain(tables.current(spark, store).collect()) == first and len(os.listdir(f"{store}/states")) == 1
    reader = tables.current(spark, store)
    second = plain(tables.replay(df.where("ts < '2024-01-05'"), ["source"], store).collect())
    assert second != first and plain(tables.current(spark, store).collect()) == second and plain(reader.collect()) == first


def test_a_replayed_batch_adds_nothing_twice(spark, tmp_path):
    schema = "key string, name string, hash string, at int"
    batches = [[("a", "x", "h1", 1), ("a", "x", "h1", 2), ("b", None, "h1", 1)], [("a", "x", "h2", 3), ("c", "y", "h1", 1), ("a", "x", "h3", 4)], [("a", "x", "h3", 5), ("b", None, "h2", 2)]]
    store = f"{tmp_path}/store"
    frames = [spark.createDataFrame(b, schema) for b in batches]
    sink = lifecycle.ingest_sink(store, ["key"], "hash", "at", F.col("name").isNotNull(), ["name"])
    want = [[("a", "h1", 1), ("b", "h1", 1)], [("a", "h2", 2), ("a", "h3", 3), ("c", "h1", 1)], [("b", "h2", 2)]]
    versions = lambda: sorted((r.key, r.hash, r.version) for r in lifecycle.stored_versions(spark, store).collect())
    sink(frames[0], 0)
    sink(frames[0], 0)
    assert versions() == sorted(want[0])
    sink(frames[1], 1)
    os.remove(f"{store}/log/1")
    assert versions() == sorted(want[0])
    sink(frames[1], 1)
    sink(frames[2], 2)
    sink(frames[1], 1)
    assert versions() == sorted(sum(want, []))
    queue = lifecycle.review_queue(spark, store).collect()
    assert sorted((r.key, r.name, r.status) for r in queue) == [("a", "x", "pending"), ("c", "y", "pending")] and len({r.queue_id for r in queue}) == 2


def test_the_sink_in_a_stream_that_is_started_again(spark, tmp_path):
    schema = "key string, hash string, at int"
    store, begin = f"{tmp_path}/store", f"{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([("a", f"h{k}", k), ("b", "h", k)], schema).coalesce(1).write.json(f"{begin}/{k}")
    sink = lifecycle.ingest_sink(store, ["key"], "hash", "at")

    def broken(batch, number):
        sink(batch, number)
        if number == 1:
            raise ValueError("lost after the batch was written")

    def start(f):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{begin}/*")
        return stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after"):
        start(broken).awaitTermination(120)
    start(sink).awaitTermination(120)
    assert sorted((r.key, r.version) for r in lifecycle.stored_versions(spark, store).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_a_source_without_a_row_is_told_as_due(spark, tmp_path):
    """s1 is silent after its first snapshot; the others' rows move the watermark past its next time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = datetime(2024, 1, 1)
    parts = [[("s1", t, True, ["a"]), ("s2", t, False, ["a"])], [("s2", t + timedelta(hours=24), True, ["a"])], [("s2", t + timedelta(hours=60), True, ["a"])], [("s3", t + timedelta(hours=61), True, ["a"])]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = lifecycle.lifecycle_stream(stream, due="1 hour").writeStream.format("memory").queryName("due").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.source, r.ts, r.health) for r in spark.table("due").collect())
    assert ("s1", t + timedelta(hours=48), "due") in got and [g for g in got if g[2] == "due"] == [("s1", t + timedelta(hours=48), "due")]
    assert len(got) == 6


def test_stream_is_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = history(5)
    os.makedirs(f"{tmp_path}/in")
    for k in range(3):
        part = pd.DataFrame(rows[k * 10 : k * 10 + 10], columns=["source", "ts", "success", "identities"])
        spark.createDataFrame(part, SNAPSHOT).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
    q = lifecycle.lifecycle_stream(stream).writeStream.format("memory").queryName("lives").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.ts, r.health, r.new, r.persistent, r.reopened, r.closed, r.absent_once) for r in spark.table("lives").collect())
    want = sorted((ts, h, n["new"], n["persistent"], n["reopened"], n["closed"], n["absent_once"]) for ts, h, n in naive(rows)[1])
    assert got == want


def test_versions_follow_the_store(spark):
    store = spark.createDataFrame([("k", "h1", 1)], "key string, hash string, version int")
    new = spark.createDataFrame([("k", "h1", 1), ("k", "h2", 2), ("k", "h2", 3), ("n", "h", 1)], "key string, hash string, ts int")
    assert sorted((r.key, r.hash, r.version) for r in lifecycle.append_versions(store, new, ["key"], "hash", "ts").collect()) == [("k", "h2", 2), ("n", "h", 1)]


def test_decision_log(spark):
    items = spark.createDataFrame([(1,), (2,)], "id int")
    log = spark.createDataFrame([(1, "pending", 1), (1, "approved", 2)], "id int, decision string, decided_at int")
    assert {r.id: r.decision for r in lifecycle.current_decisions(items, log, "id").collect()} == {1: "approved", 2: "pending"}


def test_large_snapshots_are_dealt_and_none_is_broadcast(spark, monkeypatch):
    """Sightings of large snapshots go to parts with the same rows; the snapshots, small on disk as they may be, are merged."""
    rng = random.Random(5)
    data = [(f"s{s}", d, rng.random() < 0.9, [f"i{i}" for i in range(40) if rng.random() < (0.05 if d % 5 == 4 else 0.8)]) for s in range(4) for d in range(12)]
    df = spark.createDataFrame(data, "source string, ts int, success boolean, identities array<string>")
    want = sorted(tuple(r) for r in lifecycle.lifecycle_fold(df, ["source"]).collect())
    monkeypatch.setattr(judged, "HOT", 20)
    got = judged.lifecycle_states(df, ["source"])
    assert sorted(tuple(r) for r in got.select("source", "identity", "status", "misses", "reopened").collect()) == want
    once, held = judged.sightings(df, ["source"])
    assert {r.parts for r in once.collect()} == {1, judged.PARTS} and held.select("part").distinct().count() > 1
    plan = judged._placed(once.withColumn("sound", F.col("ok")), held, ["source"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
