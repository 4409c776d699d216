"""Labels that the ladders must give to known sentences."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import ladders
from tidemark.streaming import lifecycle

COLUMNS = "id int, span string, context string, event_type string, event_status string, report_year int, subject_type string, factual_status string"


def cases(names, rows):
    """Gives a test all its cases at once, as dicts by name."""
    keys = names.split(", ")
    return lambda f: pytest.mark.parametrize("every", [[dict(zip(keys, r)) for r in rows]], ids=["all"])(f)


def many(spark, operator, every, **fixed):
    """The operator's rows of all cases, in order; what a case does not name has a usual value."""
    usual = {"context": "", "event_type": "restructuring", "status": "current", "year": 2024, "subject": "target_company", "fact": "actual_current", **fixed}
    rows = [{**usual, **{k: v for k, v in c.items() if k in usual or k == "span"}} for c in every]
    df = spark.createDataFrame([(i, r["span"], r["context"], r["event_type"], r["status"], r["year"], r["subject"], r["fact"]) for i, r in enumerate(rows)], COLUMNS)
    return zip(every, sorted(operator(df).collect(), key=lambda r: r.id))


def one(spark, operator, span, event_type="restructuring", subject="target_company", fact="actual_current", status="current", year=2024, context=""):
    df = spark.createDataFrame([(1, span, context, event_type, status, year, subject, fact)], COLUMNS)
    return operator(df).first()


@cases(
    "span, kind, period",
    [
        ("Restructuring costs (millions of dollars) 2024 24 2023 18", "table_row", "current_and_comparative"),
        ("Restructuring costs 2022 18 2021 25", "table_row", "comparative_period"),
        ("1 Represents restructuring costs included in operating expenses for 2024.", "table_footnote", "current_period"),
        ("2024 2023 24 (18 9 7 Restructuring GAAP Adjusted", "malformed_unknown_fragment", "current_and_comparative"),
        ("• We closed a site", "list_bullet", "unknown"),
        ("We will open a site in 2026.", "narrative_sentence", "future_period"),
    ],
)
def test_structure(spark, every):
    for c, r in many(spark, ladders.structure, every):
        assert (r.structure_type, r.period_binding) == (c["kind"], c["period"]), c


def test_structure_without_a_year(spark):
    assert one(spark, ladders.structure, "In 2020 and 2021 we grew.", year=None).period_binding == "multi_year_history"
    assert one(spark, ladders.structure, "In 2020 we grew.", year=None).period_binding == "explicit_single_period"


@cases(
    "span, event_type, disposition, reason",
    [
        ("Charges related to the 2022 restructuring programme were $18 million.", "restructuring", "rejected", "historical_or_comparative_disclosure"),
        ("Restructuring charges for 2024 were $24 million.", "restructuring", "rejected", "financial_observation_not_operational_event"),
        ("During 2024 we initiated a restructuring programme.", "restructuring", "accepted", "current_operational_support"),
        ("A troubled debt restructuring took place.", "restructuring", "rejected", "accounting_term_not_operational_event"),
        ("We continue to monitor supply.", "supply_chain_constraint", "ambiguous", "monitoring_statement_without_direct_occurrence"),
        ("Costs rise if we are unable to fully offset them.", "cost_reduction", "rejected", "conditional_cost_offset_not_cost_reduction_event"),
        ("From 2022 through 2026 programme", "restructuring", "rejected", "mixed_period_table_fragment"),
    ],
)
def test_table_disposition(spark, every):
    for c, r in many(spark, ladders.table_disposition, every):
        assert (r.disposition, r.disposition_reason) == (c["disposition"], c["reason"]), c


def test_accounting_rows_become_observations_once(spark):
    df = spark.createDataFrame([(i, "Restructuring charges for 2024 were $24 million.", "", "restructuring", "current", 2024, None, None) for i in (1, 1, 2)], COLUMNS)
    got = ladders.accounting_observations(ladders.table_disposition(df), ["id"]).collect()
    assert sorted((r.id, r.figure, r.operational_event_promoted) for r in got) == [(1, "2024", False), (2, "2024", False)]


@cases(
    "span, subject, fact",
    [
        ("Our suppliers experienced labour shortages.", "supplier", "actual_current"),
        ("Suppliers faced shortages which reduced our production.", "target_company", "actual_current"),
        ("Our customers faced weak demand.", "customer", "ambiguous"),
        ("Our competitors announced capacity expansion.", "competitor", "planned"),
        ("The semiconductor and the industry experienced weak demand.", "industry", "actual_current"),
        ("She previously led a restructuring programme at Company X.", "former_employer", "actual_historical"),
        ("According to analysts, weak demand could continue.", "third_party", "hypothetical_risk"),
        ("Acme plans to close its factory.", "third_party", "planned"),
        ("The acquisition target plans a site closure.", "acquisition_target", "planned"),
        ("Our joint venture announced capacity expansion.", "joint_venture", "planned"),
        ("Our subsidiary reduced capacity.", "target_subsidiary", "actual_current"),
        ("The Aviation segment reduced capacity.", "target_segment", "actual_current"),
        ("We may experience supply chain disruption.", "target_company", "hypothetical_risk"),
        ("We are at times subject to shortages.", "target_company", "actual_current_with_forecast"),
        ("Production declined.", "target_company", "actual_current"),
        ("Weak demand remains a concern.", "unknown", "ambiguous"),
    ],
)
def test_subjects(spark, every):
    plain = lambda df: ladders.attribute_subject(df.select("id", "span", "context"))
    for c, r in many(spark, plain, [{k: v for k, v in c.items() if k == "span"} | {"want": c} for c in every]):
        c = c["want"]
        assert (r.subject_type, r.factual_status) == (c["subject"], c["fact"]), c
        assert (r.segment_name or "").lower() == ("aviation" if c["subject"] == "target_segment" else "")


@cases(
    "span, event_type, subject, fact, decision, reason",
    [
        ("Our database has a redundant copy.", "redundancy", "target_company", "actual_current", "rejected", "technical_redundancy_not_workforce_event"),
        ("A supplier had labour shortages.", "labour_constraint", "target_company", "actual_current", "rejected", "supplier_labour_condition_without_target_labour_event"),
        ("Our suppliers faced a shortage.", "supply_chain_constraint", "target_company", "actual_current", "rejected", "external_subject:supplier"),
        ("Weak demand.", "demand_weakness", "unknown", "actual_current", "ambiguous", "subject_unresolved"),
        ("We may close.", "site_closure", "target_company", "hypothetical_risk", "rejected", "hypothetical_risk"),
        ("We closed it.", "site_closure", "target_company", "actual_historical", "rejected", "historical_condition"),
        ("We closed it.", "site_closure", "target_company", "actual_current", "accepted", "acceptance_contract_satisfied"),
    ],
)
def test_acceptance(spark, every):
    for c, r in many(spark, ladders.acceptance, every):
        assert (r.decision, r.decision_reason) == (c["decision"], c["reason"]), c


@cases(
    "span, subject, fact, status, verdict, code",
    [
        ("The company closed the Leeds site during 2025.", "target_company", "actual_current", "current", "accept", "DIRECT_CURRENT_EVENT"),
        ("The company plans to close the Leeds site.", "target_company", "planned", "planned", "accept", "DIRECT_PLANNED_EVENT"),
        ("The segment closed the Leeds site during 2025.", "target_segment", "actual_current", "current", "accept", "DIRECT_SEGMENT_EVENT"),
        ("A competitor closed its factory in the year.", "competitor", "actual_current", "current", "reject", "THIRD_PARTY_ONLY"),
        ("Somebody closed a factory in the year.", "unknown", "actual_current", "current", "reject", "WRONG_ENTITY"),
        ("There is a risk of closure of the site here.", "target_company", "generic_risk", "current", "reject", "HYPOTHETICAL_ONLY"),
        ("See note 12 for the closure of our sites.", "target_company", "actual_current", "current", "reject", "CROSS_REFERENCE_ONLY"),
        ("The site was closed", "target_company", "actual_current", "current", "ambiguous", "SOURCE_FRAGMENT_AMBIGUOUS"),
    ],
)
def test_verifier(spark, every):
    for c, r in many(spark, ladders.verify, every, event_type="site_closure"):
        assert (r.verdict, r.code) == (c["verdict"], c["code"]), c


def test_sufficiency(spark):
    whole = one(spark, ladders.verify_sufficient, "The subsidiary reduced capacity during 2025.", "capacity_reduction", "target_subsidiary")
    assert all(whole.sufficiency) and whole.verdict == "accept"
    part = one(spark, ladders.verify_sufficient, "Capacity reduction", "capacity_reduction", status=None)
    assert not part.sufficiency.predicate and not part.sufficiency.timing and part.code == "INSUFFICIENT_SUPPORT"
    timeless = one(spark, ladders.verify_sufficient, "We reduced capacity at our sites.", "capacity_reduction", status=None)
    assert (timeless.verdict, timeless.code) == ("ambiguous", "TIMING_AMBIGUOUS")
    assert one(spark, ladders.verify_sufficient, "Operating expenses grew strongly over the whole year.").code == "WRONG_CONTEXT"


@cases(
    "event_type, span, subject, disposition, reason",
    [
        ("growth_language", "Cost of sales increased 7% during the period.", "target_company", "reject", "expense_growth_is_not_demand_growth"),
        ("growth_language", "Revenue increased 7% during the period.", "target_company", "accept", "direct_demand_change"),
        ("cost_reduction", "Cost Reduction Initiative handbook.", "target_company", "reject", "programme_or_product_name_only"),
        ("restructuring", "Our customer announced a restructuring plan.", "target_company", "reject", "third_party_action"),
        ("restructuring", "We announced a restructuring programme during the quarter.", "target_company", "accept", "direct_or_indirect_target_action"),
        ("restructuring", "We are eliminating positions across the group.", "target_company", "accept", "direct_or_indirect_target_action"),
        ("restructuring", "The restructuring provision is described in the accounting policy.", "target_company", "ambiguous", "accounting_reference_without_action"),
        ("workforce_reduction", "We announced a reduction of 300 roles during the quarter.", "target_company", "accept", "direct_workforce_event"),
        ("labour_constraint", "A strike disrupted production at our principal plant.", "target_company", "accept", "direct_workforce_event"),
        ("hiring", "The group is recruiting engineers for its UK operations.", "target_company", "accept", "direct_workforce_event"),
        ("site_closure", "We announced that we will close the Leeds factory.", "target_company", "accept", "direct_capacity_or_delivery_event"),
        ("capacity_expansion", "The group is adding production capacity at its Texas site.", "target_company", "accept", "direct_capacity_or_delivery_event"),
        ("operational_disruption", "Production was paused following the incident.", "target_company", "accept", "direct_capacity_or_delivery_event"),
        ("supply_chain_constraint", "Our production was affected by a component shortage.", "target_company", "accept", "direct_supply_condition"),
        ("destocking", "Our sales were impacted by customer destocking during the period.", "target_company", "accept", "direct_supply_condition"),
        ("recall", "The company initiated a recall of the affected product.", "target_company", "accept", "direct_quality_or_regulatory_event"),
        ("quality_failure", "A quality issue resulted in additional inspection work.", "target_company", "accept", "direct_quality_or_regulatory_event"),
        ("regulatory_intervention", "The regulator ordered the company to suspend production.", "target_company", "accept", "direct_quality_or_regulatory_event"),
        ("transformation", "We launched a business transformation programme this year.", "target_company", "accept", "direct_change_execution_event"),
        ("leadership_change", "The company appointed a new Chief Operating Officer.", "target_company", "accept", "direct_change_execution_event"),
        ("site_closure", "A competitor closed its factory.", "third_party", "reject", "wrong_entity"),
        ("site_closure", "There is a risk of site closure.", "target_company", "reject", "hypothetical_only"),
        ("recall", "The company did not initiate a product recall.", "target_company", "reject", "negated_event"),
        ("transformation", "Her biography says she led transformation at a previous employer.", "target_company", "reject", "biography_or_prior_employer"),
        ("supply_chain_constraint", "Supply disruption could adversely affect production.", "target_company", "reject", "hypothetical_only"),
        ("no_such_type", "We closed the site.", "target_company", "ambiguous", "family_not_implemented"),
    ],
)
def test_families(spark, every):
    for c, r in many(spark, ladders.verify_family, every):
        assert (r.disposition, r.reason) == (c["disposition"], c["reason"]), c


def test_every_type_has_one_family():
    types = list(ladders.FAMILIES)
    assert len(types) == 41 and set(ladders.FAMILIES.values()) == set(ladders.REASONS) and len(ladders.REASONS) == 7


def test_ambiguity_and_failure_classes(spark):
    df = spark.createDataFrame([("We may appoint; the supplier, named last year", "", "workforce", "current", "positive", "FALSE_POSITIVE", "x")], "span string, context string, family string, timing string, polarity string, classification string, event_type string")
    r = ladders.failure_class(ladders.ambiguity_categories(df)).first()
    assert r.categories == ["event_identity_ambiguity", "executive_appointments", "historical_vs_current", "hypothetical_vs_actual", "issuer_vs_third_party", "polarity_ambiguity", "workforce"]
    assert (r.failure_class, r.expected, r.expected_status) == ("hypothetical_risk", "rejected", "hypothetical_or_irrelevant")
    rows = [("We served as", "DUPLICATE_EVENT", "a", "duplicate", "rejected"), ("A career", "AMBIGUOUS", "a", "biography", "ambiguous"), ("Plain", "MISSED_EVENT", "major_investment", "synonym_or_phrase_structure_missing", "accepted"), ("Plain", "OTHER", "a", "unadjudicated_plausible_ai_omission", "ambiguous")]
    got = ladders.failure_class(spark.createDataFrame(rows, "span string, classification string, event_type string, want string, decision string")).collect()
    assert all(r.failure_class == r.want and r.expected == r.decision for r in got)


def test_verdicts_combine(spark):
    kinds = ["accept", "reject", "ambiguous"]
    df = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "a string, b string").withColumn("c", ladders.combine(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.c == ("accept" if r.a == r.b == "accept" else "reject" if "reject" in (r.a, r.b) else "ambiguous")


def test_job_states(spark):
    old = "k string, identity string, title string, location string, status string, misses int"
    previous = spark.createDataFrame([("a", str(i), f"T{i}", "Rome", "open", 1 if i == 1 else 0) for i in range(5)] + [("a", "z", "Old job!", "New  York", "closed", 2), ("b", "q", "Q", "X", "open", 0)], old)
    seen = spark.createDataFrame([("a", "0", "T0", "Rome"), ("a", "2", "T2", "Rome"), ("a", "n", "old JOB", "new york"), ("a", "m", "Other", "Rome")], "k string, identity string, title string, location string")
    got = {r.identity: (r.status, r.misses, r.repost_of) for r in lifecycle.job_states(previous, seen, ["k"]).collect()}
    assert got == {"0": ("open", 0, None), "1": ("closed", 2, None), "2": ("open", 0, None), "3": ("open", 1, None), "4": ("open", 1, None), "z": ("closed", 2, None), "n": ("open", 0, "z"), "m": ("open", 0, None), "q": ("open", 1, None)}
    failed = {r.identity: (r.status, r.misses) for r in lifecycle.job_states(previous, seen, ["k"], success=False).collect()}
    assert failed == {r.identity: (r.status, r.misses) for r in previous.collect()}
    outage = {r.identity: r.misses for r in lifecycle.job_states(previous, seen.where("identity = '0'"), ["k"]).collect() if r.k == "a"}
    assert outage == {"0": 0, "1": 1, "2": 0, "3": 0, "4": 0, "z": 2}


def test_sequence_ratio_and_source_text(spark):
    import difflib
    import unicodedata

    pairs = [("abcd", "bcde"), ("", "x"), ("same", "same"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(tx.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs[:3]]
    raw = "\uff21\u201cq\u201d\u0007  x"
    assert spark.createDataFrame([(raw,)], "t string").select(tx.visible_source_text(F.col("t"))).first()[0] == unicodedata.normalize("NFKC", 'A"q" x')


def test_visible_source_of_every_sign_by_small_batches(spark):
    """Each sign is kept or left out by its category; whole texts do not come by Arrow's batches, which hold 10,000 of them."""
    import unicodedata

    from pyspark.util import PythonEvalType

    assert tx.visible_source_text.evalType == PythonEvalType.SQL_BATCHED_UDF
    quotes = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'})
    plain = lambda s: " ".join("".join(c for c in unicodedata.normalize("NFKC", s).translate(quotes) if c.isspace() or unicodedata.category(c)[0] != "C").split())
    raw = ["x" + "".join(map(chr, range(a, a + 256))) + "y" for a in range(0, 0x20000, 256) if not 0xD800 <= a < 0xE000] + ["", "‘’ “”", None]
    df = spark.createDataFrame(list(enumerate(raw)), "id int, t string")
    got = dict(df.select("id", tx.visible_source_text("t")).collect())
    assert got == {i: None if s is None else plain(s) for i, s in enumerate(raw)}


def made(rng, parsed):
    """A string that a parsed pattern matches, by chance."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "ANY":
                out += rng.choice("ax ")
            case "IN":
                lows = [chr(rng.randint(*a)) if str(o) == "RANGE" else chr(a) for o, a in arg if str(o) in ("RANGE", "LITERAL")]
                out += rng.choice(lows) if lows else {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": " "}[str(arg[0][1])]
            case "MAX_REPEAT":
                out += "".join(made(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            case "SUBPATTERN":
                out += made(rng, arg[3])
            case "BRANCH":
                out += made(rng, rng.choice(arg[1]))
            case "AT":
                pass
            case other:
                raise ValueError(other)
    return out


def test_every_match_has_what_its_pattern_needs(spark):
    """Texts that each pattern matches, in any case, have its wording; no label changes by it, and a text is lowered once."""
    import random
    import re

    rng, texts = random.Random(3), []
    for pattern in [*ladders.NEEDS, *ladders.STARTS]:
        hits = [made(rng, re._parser.parse(pattern)) for _ in range(150)]
        hits = [h for h in hits if re.search("(?i)" + pattern, h)]
        needs, starts = ladders.NEEDS.get(pattern, [""]), ladders.STARTS.get(pattern)
        assert len(hits) > 20 and all(any(w in h.lower() for w in needs) for h in hits), pattern
        assert all(any(w in h.lower() for h in hits) for w in needs), pattern
        assert starts is None or {h[0].lower() for h in hits} == set(starts), pattern
        texts += [t for h in hits[:20] for t in (f"And {h} now", f"{h}.".upper(), h[:-3], f"The Kelvin {h}")]
    df = spark.createDataFrame([(i, t, texts[-i % len(texts)] if i % 3 else None) for i, t in enumerate([*texts, None, ""])], "id int, span string, context string")
    guarded = df.withColumn("low", F.lower("span"))
    wrong = [F.coalesce(F.col("span").rlike("(?i)" + p), F.lit(False)) != ladders.has("span", p, low="low") for p in [*ladders.NEEDS, *ladders.STARTS]]
    assert guarded.select(*(F.count_if(w).alias(f"w{k}") for k, w in enumerate(wrong))).first() == (0,) * len(wrong)
    out = ladders.attribute_subject(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 2
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ladders, "may_have", lambda low, pattern: F.lit(True))
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, ladders.attribute_subject(df).collect()))
