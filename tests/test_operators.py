"""Scenarios on small fixtures."""

import json
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse, text
from tidemark.operators import conditions, evaluation, extraction, integrity, joins, longitudinal, pointintime, sampling, scoring
from tidemark.plans import catalog


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rank_metrics_match_pairs(spark):
    rng = random.Random(3)
    data = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(200)]
    r = evaluation.rank_metrics(spark.createDataFrame(data, "score double, label int")).first()
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(r.auc - auc) < 1e-12
    assert abs(r.brier - sum((p - y) ** 2 for p, y in data) / 200) < 1e-12
    assert r.fp == sum(p >= 0.5 and not y for p, y in data) and r.fn == sum(p < 0.5 and y for p, y in data)


def test_constant_score_has_prevalence_as_ap(spark):
    r = evaluation.rank_metrics(spark.createDataFrame([(0.3, 1), (0.3, 0), (0.3, 0), (0.3, 0)], "score double, label int")).first()
    assert r.ap == 0.25 and r.auc == 0.5


def test_one_class_has_no_auc(spark):
    r = evaluation.rank_metrics(spark.createDataFrame([(0.3, 1), (0.6, 1)], "score double, label int")).first()
    assert r.auc is None


def test_numbered_is_the_order_of_the_key(spark):
    keys = [None, *(f"c{k * 7919 % 3001}" for k in range(3000))]
    df = spark.createDataFrame([(k,) for k in keys], "c string").repartition(7)
    got = {r.c: r.k for r in evaluation.numbered(df, "c").collect()}
    assert got == {c: i for i, c in enumerate([None, *sorted(keys[1:])])}
    assert evaluation.numbered(df.limit(0), "c").count() == 0


def test_rank_metrics_of_groups_are_those_of_each_alone(spark):
    rows = [(g, (k * 37 % 101) / 101, int(k % 3 == 0)) for g, n in (("hot", 900), ("cold", 7)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    for r in evaluation.rank_metrics(df, by=["g"]).collect():
        alone = evaluation.rank_metrics(df.where(df.g == r.g)).first().asDict()
        assert {k: round(v, 9) for k, v in alone.items()} == {k: round(v, 9) for k, v in r.asDict().items() if k != "g"}


def test_bootstrap_is_reproducible(spark):
    df = spark.createDataFrame([(f"c{i % 5}", i / 20, i % 2) for i in range(20)], "c string, score double, label int")
    a, b, c = (evaluation.bootstrap(df, "c", 30, seed).first() for seed in (1, 1, 2))
    assert a == b and a != c and a.low <= a.mid <= a.high


def test_as_of_means_end_of_day(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 23, 59, 59)), (2, datetime(2024, 1, 2)), (3, None)], "id int, available_at timestamp")
    assert rows(pointintime.as_of(df, "2024-01-01").select("id")) == [(1,)]


def test_blind_refuses_forbidden_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, score int")
    assert pointintime.blind(df, ["a"], ["score"]).columns == ["a"]
    with pytest.raises(ValueError):
        pointintime.blind(df, ["a", "score"], ["score"])


def test_resolution_does_not_fan_out(spark):
    p = spark.createDataFrame([("a", "t", "2024-01-05")], "company_id string, target string, cutoff string")
    o = spark.createDataFrame([("a", "t", "2024-01-05", "no", "resolved", 1), ("a", "t", "2024-01-05", "yes", "resolved", 2)], "company_id string, target string, ws string, outcome string, status string, resolved_at int").withColumn("window_start", F.to_date("ws"))
    assert [r.outcome for r in pointintime.resolve_outcomes(p, o).collect()] == ["yes"]


def test_supplier_resolution_fails_closed(spark):
    a = spark.createDataFrame([("Acme Ltd", 1), ("ACME plc", 2), ("Best Group", 3)], "alias string, company_id int")
    got = {r.supplier: (r.company_id, r.resolution) for r in joins.resolve_suppliers(spark.createDataFrame([("Acme",), ("Best",), ("None",)], "supplier string"), a).collect()}
    assert got == {"Acme": (None, "manual_review"), "Best": (3, "accepted"), "None": (None, "manual_review")}


def test_cluster_cap(spark):
    df = spark.createDataFrame([("x", "f", "k", 1.0), ("x", "f", "k", 1.0), ("x", "unknown", "l", 1.0)], "company_id string, family string, cluster string, strength double")
    for c in ("reliability", "quality", "materiality", "independence", "relevance", "direction"):
        df = df.withColumn(c, F.lit(1.0))
    df = df.withColumn("feature", F.lit("z")).withColumn("event_date", F.lit("2024-01-01")).withColumn("available_at", F.lit("2024-01-01")).withColumn("own_source", F.lit(False))
    r = scoring.evidence_model(df, "2024-01-01", {"f": 0.5}).first()
    assert abs(r.evidence_sum - 0.2) < 1e-9 and r.clusters == 2


def test_rules_score_rejects_out_of_range(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5), (1.5, 0.5, None, 0.5)], "pressure_language double, margin_pressure double, cash_pressure double, contrary_strength double")
    good, bad = scoring.rules_score(df).orderBy(F.size("error")).collect()
    assert 0 < good.probability < 1 and bad.probability is None and bad.error == ["pressure_language", "cash_pressure"]


def test_weighted_score_rounds_half_even(spark):
    df = spark.createDataFrame([("a", 0.01, 1.0)], "id string, strength double, independence double")
    for c in ("reliability", "materiality", "recency", "direction"):
        df = df.withColumn(c, F.lit(1.0))
    assert scoring.weighted_score(df, ["id"]).first().score == 50


def test_disclosure_rule_looks_around(spark):
    f = scoring.disclosure_rule(["restructuring"], ["troubled debt"], 20)
    df = spark.createDataFrame([("a Restructuring plan",), ("troubled debt restructuring",), (None,)], "t string")
    assert [r[0] for r in df.select(f("t")).collect()] == [True, False, False]


def test_corroboration_ladder(spark):
    data = [("one", "a", "f", None, False), ("dup", "a", "f", "g", False), ("dup", "b", "f", "g", False), ("ind", "a", "f", None, False), ("ind", "b", "h", None, False), ("fam", "a", "f", None, False), ("fam", "b", "f", None, False), ("con", "a", "f", None, True)]
    df = spark.createDataFrame(data, "c string, observation_id string, source_family string, derivative_group string, contradicts boolean")
    got = {r.c: r.status for r in conditions.corroboration(df, ["c"]).collect()}
    assert got == {"one": "DUPLICATE_ONLY", "dup": "DUPLICATE_ONLY", "ind": "INDEPENDENT", "fam": "MULTIPLE_OBSERVATIONS_ONE_FAMILY", "con": "CONTRADICTORY"}


def test_period_change_needs_same_currency(spark):
    data = [("a", "m", "2023", 10.0, "GBP"), ("a", "m", "2024", 12.0, "GBP"), ("b", "m", "2023", 10.0, "GBP"), ("b", "m", "2024", 12.0, "USD"), ("c", "m", "2023", 0.0, "GBP"), ("c", "m", "2024", 1.0, "GBP")]
    df = spark.createDataFrame(data, "company string, metric string, period string, value double, currency string").withColumns({"unit": F.lit("m"), "observation_date": F.lit(None).cast("date"), "publication_date": F.concat("period", F.lit("-03-01")).cast("date")})
    out = longitudinal.period_change(df, ["company", "metric"]).collect()
    assert [(r.company, round(r.pct_change, 6)) for r in out] == [("a", 0.2)]


def test_persistence_ladder(spark):
    series = {"stable": [3, 3, 3], "reversed": [1, 3, 2], "once": [1, 2, 2], "faster": [1, 2, 4], "steady": [1, 2, 3], "single": [1]}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k string, t int, v int")
    got = {r.k: r.persistence for r in longitudinal.persistence_status(df, ["k"], "t", "v").collect()}
    assert got == {"stable": "STABLE", "reversed": "REVERSED", "once": "ONE_OFF", "faster": "ACCELERATING", "steady": "PERSISTENT", "single": "NOT_ASSESSED"}


def test_register_is_immutable(spark):
    store = spark.createDataFrame([("a", 1)], "k string, v int")
    new, clash = integrity.register(store, spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int"), ["k"], ["v"])
    assert rows(new) == [("b", 2)] and not clash.count()
    assert integrity.register(store, spark.createDataFrame([("a", 2)], "k string, v int"), ["k"], ["v"])[1].count() == 1


def test_quota_shortfall_is_told(spark):
    df = spark.createDataFrame([("f", "accept", i) for i in range(3)], "family string, label string, id int")
    kept, short = sampling.balanced(df, "family", "label", {"accept": 2, "reject": 1}, "id")
    assert kept.count() == 2 and [(r.label, r.n, r.quota) for r in short.collect()] == [("reject", 0, 1)]


@pytest.mark.parametrize(
    "sentence, decision, status",
    [
        ("We announced a restructuring of the European business this quarter.", "accepted", "current"),
        ("We have no plans for a restructuring of the business at present.", "rejected", "negated"),
        ("The restructuring was previously announced and our teams finished it.", "rejected", "historical"),
        ("We may consider restructuring if conditions in our market get worse.", "rejected", "hypothetical"),
        ("Competitors are restructuring their distribution networks this year.", "rejected", "third_party"),
        ("Restructuring of distribution networks in several further regions.", "ambiguous", "ambiguous"),
    ],
)
def test_assessment_ladder(spark, sentence, decision, status):
    c = extraction.candidates(spark.createDataFrame([(1, sentence)], "id int, text string"), "text", ["id"], {"restructuring": r"restructur(?:e|ed|ing)"})
    r = extraction.assess(c).first()
    assert (r.decision, r.status) == (decision, status)


def test_near_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([(1, "d", "We closed the plant in Leeds this year"), (2, "d", "We closed the plant in Leeds this  year!"), (3, "d", "We closed the plants in Leeds this year"), (4, "d", "Revenue grew")], "at int, doc string, span string")
    assert sorted(rows(extraction.near_duplicate_events(df, ["doc"], "at", "span"))) == [("d", 2, 1), ("d", 3, 1)]


def test_labelled_figures(spark):
    body = "[Page 2]\nRevenue: £1.5bn\nMargin: 12.5%\nOther: n/a"
    got = extraction.labelled_figures(spark.createDataFrame([(1, body)], "id int, text string"), "text", ["id"], {"revenue": "revenue", "margin": "margin", "other": "other"}).collect()
    assert {(r.page, r.metric, r.value, r.unit) for r in got} == {(2, "revenue", 1500.0, "GBP"), (2, "margin", 12.5, "percent")}


def test_scalar_functions(spark):
    df = spark.createDataFrame([("Senior Data Scientist", None, "Leeds, Yorkshire, United Kingdom")], "title string, dept string, place string")
    r = df.select(parse.job_function(F.col("title"), F.col("dept")).alias("f"), parse.job_seniority(F.col("title")).alias("s"), parse.geography(F.col("place")).alias("g"), text.span_offsets(F.lit("abcabc"), F.lit("bc")).alias("o"), parse.cell_number(F.lit("(1,234)")).alias("n")).first()
    assert (r.f, r.s, tuple(r.g), r.o, r.n) == ("data_ai", "individual_contributor", ("United Kingdom", "Yorkshire", "Leeds"), [1, 4], -1234.0)


def test_canonical_json_matches_json(spark):
    row = {"b": 'say "hi"\\', "a": "é\nz", "c": None}
    df = spark.createDataFrame([(row["a"], row["b"], row["c"])], "a string, b string, c string")
    assert df.select(text.canonical_json(["a", "b", "c"])).first()[0] == json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_facts_validated(spark):
    df = spark.createDataFrame([("We cut jobs.", 10, "cut jobs", "We", "cut", "jobs", "issuer"), ("We cut jobs.", 10, "cut plants", "We", "cut", "plants", "issuer"), ("We cut jobs.", 10, "cut jobs", "We", "cut", "jobs", None)], "zone string, zone_start int, span string, subject string, action string, object string, entity string")
    assert [(r.verdict, r.start) for r in extraction.validate_facts(df).collect()] == [("accept", 13), ("reject", None), ("ambiguous", 13)]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dup_events_of_long_documents(spark, tmp_path):
    a, b = "The licensed parts are delivered to all sites in the north.", "The licensed parts are delivered to all sites in the south."
    fill = "Nothing else is said in this part of the report at all. " * 20
    spark.createDataFrame([(1, f"{a} {fill}{b}", "en", "s", 1300), (2, f"{a} {b}", "en", "s", None), (3, a, "en", "s", 60)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(rows(catalog.queries()["near_dup_events"](spark, str(tmp_path)).select("doc_id", "event_type", "position", "canonical")))
    assert got == [(1, "licence", 21, 0), (2, "licence", 1, 0)]


def test_near_duplicate_chains_change_nothing(spark):
    import difflib

    rng = random.Random(7)
    base = ["the plant in the north was closed", "revenue grew in all regions of the group and in the markets that it serves", "a new site"]
    data = []
    for k in range(60):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = rng.choice(["x", "yy", "zzz"])
        data.append((k, "d", " ".join(words)))
    kept, want = [], []
    for k, _, t in data:
        hit = next((i for i, s in kept if difflib.SequenceMatcher(None, s, t).ratio() >= 0.86), None)
        if hit is None:
            kept.append((k, t))
        else:
            want.append(("d", k, hit))
    df = spark.createDataFrame(data, "at int, doc string, span string")
    assert sorted(rows(extraction.near_duplicate_events(df, ["doc"], "at", "span"))) == want


@pytest.mark.parametrize("name", ["token_similarity_pairs", "same_events", "mix_trajectory", "merge_events", "occasion_completeness", "careers_history", "watchlist"])
def test_queries_read_whole_tables(name):
    sql = catalog.oracle_sql()[name]
    assert not any(cut in sql for cut in ("n_chars <", "user_id <", "user_id % 5", "event_id % 3", "c_custkey <"))
    assert catalog.oracle_sql()[f"{name}_whole"] == sql


def test_best_similarity_against_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, "b", " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(texts, "id int, block string, text string")
    got = {(r.left_id, r.right_id): (r.match, r.similarity) for r in joins.best_similarity(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["block"], 0.5).collect()}
    sets = {i: set(t.split()) for i, _, t in texts}
    want, used = {}, set()
    for i in range(0, 60, 2):
        best = max(((len(sets[i] & sets[j]) / len(sets[i] | sets[j]), j) for j in range(1, 60, 2) if sets[i] | sets[j]), default=(0, None))
        if best[0] >= 0.5:
            want[(i, best[1])] = ("agreed", best[0])
            used.add(best[1])
        else:
            want[(i, None)] = ("unmatched", None)
    want |= {(None, j): ("right_only", None) for j in range(1, 60, 2) if j not in used}
    assert got == want


def test_span_offsets_of_edge_cases(spark):
    rows = [("abcabc", "bc", [1, 4]), ("aaaa", "aa", [0, 2]), ("a.b\\E.", ".", [1, 5]), ("x\\Ey", "\\E", [1]), ("", "a", []), ("abc", "", []), ("abc", None, []), (None, "a", None), ("é😀é", "é", [0, 2]), ("ab" * 200000, "ab", list(range(0, 400000, 2)))]
    df = spark.createDataFrame(rows, "text string, span string, want array<int>")
    for r in df.select("want", text.span_offsets(F.col("text"), F.col("span")).alias("got")).collect():
        assert r.got == r.want


def mutated(rng, words, n):
    """Texts of which many are copies with a few changes, some are short, some repeat one word."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice("abcxyz ") * rng.randint(0, 2)
            out.append("".join(t))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 12, 30]))))
    return out


@pytest.mark.parametrize("least", [0.86, 0.78, 0.6])
def test_near_duplicate_events_are_greedy(spark, least):
    import difflib
    import random
    import re

    rng = random.Random(int(least * 100))
    words = ["plant", "closure", "the", "a", "of", "capacity", "aaaa", "b", "Leeds", "2024", "growth", "é漢"]
    data = [(k, f"g{k % 3}", "type", t) for k, t in enumerate(mutated(rng, words, 220))] + [(900, "g0", "type", None), (901, None, "type", "x"), (902, "g0", "type", ""), (903, "g0", "type", "!!"), (904, "g1", "type", "a" * 300), (905, "g1", "type", "a" * 290 + "b" * 9)]
    want = []
    for g in ("g0", "g1", "g2"):
        kept = []
        for at, _, _, t in (r for r in data if r[1] == g and r[3] is not None):
            t = re.sub(r"\W+", " ", t.lower()).strip()
            hit = next((k for k, s in kept if s == t or difflib.SequenceMatcher(None, s, t).ratio() >= least), None)
            if hit is None:
                kept.append((at, t))
            else:
                want.append((g, "type", at, hit))
    df = spark.createDataFrame(data, "at int, doc string, kind string, span string")
    got = extraction.near_duplicate_events(df, ["doc", "kind"], "at", "span", least)
    assert sorted(rows(got)) == sorted(want) and len(want) > 40
    assert extraction.near_duplicate_events(df.limit(0), ["doc", "kind"], "at", "span", least).count() == 0


def test_first_come_rounds(spark):
    import random

    rng = random.Random(1)
    edges = sorted({(k, a, b) for k in "xy" for a in range(60) for b in range(a + 1, 60) if b == a + 1 or rng.random() < 0.03})
    want = {}
    for k in "xy":
        for i in range(60):
            want[k, i] = not any(want[k, a] for g, a, b in edges if g == k and b == i)
    df = spark.createDataFrame(edges, "k string, left_id int, right_id int")
    assert {(r.k, r.id): r.kept for r in extraction.first_come(df, ["k"]).collect()} == want


def test_same_events_scores_few_pairs(spark):
    """The pairs are those of brute force; sizes and places of shared tokens keep most other pairs from being scored."""
    import random

    rng = random.Random(7)
    words = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(4000)]
    data = [(i, "b", f"2024-01-{i % 28 + 1:02d}", " ".join(rng.sample(words, rng.randint(1, 60)))) for i in range(150)]
    data += [(200 + i, "b", "2024-01-03", data[i][3] + " more words") for i in range(30)]
    df = spark.createDataFrame(data, "id int, block string, day string, text string").withColumn("day", F.to_date("day"))
    bags = {i: (set(t.split()), int(d[-2:])) for i, _, d, t in data}
    for least in (0.65, 0.3):
        pairs = {(i, j): len(a & b) / len(a | b) for i, (a, x) in bags.items() for j, (b, y) in bags.items() if i < j and abs(x - y) <= 14 and a & b}
        want = {p: s for p, s in pairs.items() if s >= least}
        got = {(r.left_id, r.right_id): r.similarity for r in joins.same_events(df, ["block"], 14, least).collect()}
        assert got == want
        assert len(want) <= joins.event_candidates(joins.token_sets(df, ["block"]), ["block"], 14, least).count() <= max(3 * len(want), len(pairs) // 20)


def test_meeting_at_common_tokens_in_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 3)
    df = spark.createDataFrame([(i, "b", "2024-01-01", "same words here " + ("" if i % 2 else f"x{i}")) for i in range(40)], "id int, block string, day string, text string").withColumn("day", F.to_date("day"))
    assert joins.same_events(df, ["block"], 14, 0.7).count() == 20 * 19 // 2 + 20 * 20


def _tile_rows(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return [(i, rng.choice(["a", "b", None]), f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d}", t) for i, t in enumerate(texts)]


def test_same_events_in_many_tiles(spark, monkeypatch):
    """Each pair is found once, whatever the parts its rows are in; only pairs that have the similarity leave a tile."""
    from datetime import date

    from tidemark.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 60)
    data = _tile_rows(3, 160)
    df = spark.createDataFrame(data, "id int, block string, day string, text string").withColumn("day", F.to_date("day"))
    bags = {i: (b, date.fromisoformat(d).toordinal(), set(t.split())) for i, b, d, t in data if b and t}
    sim = {(i, j): len(x[2] & y[2]) / len(x[2] | y[2]) for i, x in bags.items() for j, y in bags.items() if i < j and x[0] == y[0] and abs(x[1] - y[1]) <= 14}
    got = joins.same_events(df, ["block"], 14, 0.4)
    assert sorted(tuple(r) for r in got.select("left_id", "right_id", "similarity").collect()) == sorted((*p, s) for p, s in sim.items() if s >= 0.4)
    assert "explode(t" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_same_events_shuffle_less_than_their_tokens(spark):
    """Rows of a block that fits a task are copied once, with the frequent tokens in two bytes each."""
    import time

    def written():
        time.sleep(1)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    rng = random.Random(5)
    data = [(i, "b", f"2024-01-{i % 28 + 1:02d}", " ".join(f"w{rng.randint(0, 3000)}" for _ in range(300))) for i in range(1500)]
    data += [(2000 + i, "b", "2024-01-15", data[i][3]) for i in range(0, 1500, 100)]
    df = spark.createDataFrame(data, "id int, block string, day string, text string").withColumn("day", F.to_date("day"))
    before = written()
    assert joins.same_events(df, ["block"], 14, 0.4).count() == 15
    assert written() - before < 8 * sum(len(set(t.split())) for *_, t in data)


@pytest.mark.parametrize("own", [True, False])
def test_pairs_of_a_tile(monkeypatch, own):
    """Coded sets counted in small steps give the pairs of brute force, also those of frequent tokens only."""
    import pyarrow as pa

    from tidemark.operators import tiles

    for name, value in (("HELD", 64), ("WIDTH", 37), ("PAIRS", 256), ("MOST_HITS", 50)):
        monkeypatch.setattr(tiles, name, value)
    rng = random.Random(own)
    data = []
    for i in range(300):
        c = {min(int(rng.paretovariate(0.5)), 6000) - 1 for _ in range(rng.randint(1, 60))}
        r = {rng.randint(0, 300) for _ in range(rng.randint(0, 8))}
        if i % 5 == 4:
            c, r = set(data[-1][3]), set(data[-1][4]) ^ {rng.randint(0, 300)}
        data.append((f"k{i}", 2 if own else rng.randint(0, 1), rng.randint(0, 27), sorted(c), sorted(r)))
    names, roles, days, cs, rs = zip(*data)
    tile = pa.table({"_role": pa.array(roles, pa.int32()), "block": ["b"] * len(data), "id": names, "number": pa.array(days, pa.int32()), "n": pa.array([len(c) + len(r) for c, r in zip(cs, rs)], pa.int32()), "c": pa.array([[x - 32768 for x in c] for c in cs], pa.list_(pa.int16())), "r": pa.array(rs, pa.list_(pa.int64()))})
    got = [tuple(x.values()) for batch in tiles.pairs_of(tile, ["block"], 0.4, 14) for x in batch.to_pylist()]
    bags = [set(c) | {x + 10**6 for x in r} for c, r in zip(cs, rs)]
    sim = {(i, j): len(bags[i] & bags[j]) / len(bags[i] | bags[j]) for j in range(len(data)) for i in range(j) if (own or roles[i] != roles[j]) and abs(days[i] - days[j]) <= 14}
    want = [("b", *sorted((names[i], names[j])), s) for (i, j), s in sim.items() if s >= 0.4]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_best_similarity_in_many_tiles(spark, monkeypatch):
    """The best of all tiles counts, with ties to the larger id, also where only the lowest threshold is reached."""
    from tidemark.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 60)
    data = _tile_rows(4, 160)
    df = spark.createDataFrame(data, "id int, block string, day string, text string").drop("day")
    bags = {i: (b, set(t.split())) for i, b, _, t in data if b and t}
    want = {}
    for i, (b, x) in bags.items():
        found = [(len(x & y) / len(x | y), j) for j, (k, y) in bags.items() if i % 2 == 0 and j % 2 and k == b]
        if found and max(found)[0] >= 0.15:
            want[i] = max(found)
    got = joins.best_similarity(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["block"])
    assert {r.left_id: (r.similarity, r.right_id) for r in got.where("match = 'agreed'").collect()} == want
    assert got.where("match = 'unmatched'").count() == 80 - len(want)


def test_lexicon_events_word_bounds(spark, tmp_path):
    """A negation is a word of its own in every script, in the query and in its SQL."""
    import duckdb

    heads = ["Some noñijaos and", "Some ñno and", "Some no² and", "Some no-one and", "Some no_ and", "Some nor", "Was completedé in", "Was completed in"]
    data = [(i, h + " the licence of this text here.") for i, h in enumerate(heads)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "event_type", "position", "sentence", "status", "quantified"]
    theirs = con.sql(catalog.oracle_sql()["lexicon_events"]).select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    mine = rows(catalog.queries()["lexicon_events"](spark, str(tmp_path)).select(*columns))
    assert sorted(mine) == sorted(theirs)
    now, then, no = "current_or_general", "historical_or_completed", "negated"
    assert [r[4] for r in sorted(mine)] == [now, now, no, no, now, no, now, then]


def test_best_of_counts_rows_together(monkeypatch):
    """Counts by product and by lists, some rows at a time, are those of each pair; equal bests go to the larger id."""
    from tidemark.operators import tiles

    for name, value in {"DENSE": 3, "MOST_ROWS": 7, "MOST_HITS": 20}.items():
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(5)
    bags = [rng.choice(40, rng.integers(1, 9), replace=False) for _ in range(120)]
    tile = pd.DataFrame({"block": "a", "id": np.arange(120), "t": bags, "_role": np.arange(120) % 2})
    want = {}
    for i in range(0, 120, 2):
        best = max((len(set(bags[i]) & set(bags[j])) / len(set(bags[i]) | set(bags[j])), j) for j in range(1, 120, 2))
        if best[0] >= 0.15:
            want[i] = best
    got = tiles.best_of(tile, ["block"], 0.15)
    assert {r.left_id: (r.similarity, r.right_id) for r in got.itertuples()} == want
    assert len(tiles.best_of(tile[tile["_role"] == 0], ["block"], 0.15)) == 0


def test_alike_matches_few_pairs(monkeypatch):
    """The pairs with the ratio are those of the plain matcher, which is asked where common characters allow it, and reads a text once."""
    import difflib

    rng = random.Random(9)
    base = ["".join(rng.choice(w) for _ in range(rng.choice([0, 5, 40, 260]))) for w in ["abc ", "defgh", "a b1", "xyz"] * 8]
    texts = base + [t[:-2] + "q" + t[3:] for t in base]
    pairs = [(a, b) for a in texts for b in texts]
    for least in (0.6, 0.86, 1.0):
        want = [difflib.SequenceMatcher(None, a, b).ratio() >= least for a, b in pairs]
        asked, read = [], []
        with monkeypatch.context() as m:
            plain, seq2 = difflib.SequenceMatcher.ratio, difflib.SequenceMatcher.set_seq2
            m.setattr(difflib.SequenceMatcher, "ratio", lambda self: asked.append(1) or plain(self))
            m.setattr(difflib.SequenceMatcher, "set_seq2", lambda self, b: read.append(b) or seq2(self, b))
            assert extraction.alike([a for a, _ in pairs], [b for _, b in pairs], least) == want
        assert len(asked) < len(pairs) / 2 and len(read) <= len(set(texts)) + 1


def test_outcome_window_join_in_parts_of_lines(spark, tmp_path, monkeypatch):
    """Orders with a key that is there twice have windows of their own, and parts are as many as the lines need."""
    from datetime import timedelta

    import duckdb

    from tidemark.plans import pointintime as plans

    rng, day = random.Random(4), datetime(2024, 1, 1)
    orders = [(k, None if k == 7 else day + timedelta(rng.randrange(90))) for k in [*range(60), *range(0, 60, 3), 5, 5, None]]
    lines = [(rng.choice([k, None] if k == 9 else [k]), day + timedelta(rng.randrange(150)), n, rng.choice("ANR") if rng.random() < 0.9 else None, rng.choice(["F", "O", None])) for k in range(70) for n in range(k % 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp_ntz, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    theirs = con.sql(catalog.oracle_sql()["outcome_window_join"]).select(*map(duckdb.ColumnExpression, ["o_orderkey", "outcome", "shipped"])).fetchall()
    monkeypatch.setattr(plans, "PART_LINES", 10, raising=False)
    mine = catalog.queries()["outcome_window_join"](spark, str(tmp_path))
    assert sorted(rows(mine), key=repr) == sorted(theirs, key=repr)
    assert mine.rdd.getNumPartitions() == -(-len(lines) // 10)
