"""Queries of the rules on candidates, over all sentences of documents; the oracles state the rules' order as cases.

A span is a sentence of a document behind a subject and a verb that the place of the sentence picks, so that
rules of every kind meet whole tables. Signs beyond ASCII are left out of it, as the two engines' word
bounds differ there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import extraction as ex
from tidemark.operators import ladders as la
from tidemark.plans.documents import SENTENCES
from tidemark.plans.registry import query
from tidemark.streaming import judged
from tidemark.streaming import lifecycle as lc

SUBJECTS = ["We", "The company", "Our suppliers", "Our customers", "The industry", "Acme Systems segment", "Our subsidiary", "According to analysts,", "Competitors", "Nobody", "The customer", "See note 3:"]
VERBS = ["announced a restructuring programme", "may face risk of disruption", "experienced lower capacity", "closed the site", "previously announced savings", "plans to expand capacity", "served as director", "is defined as", "increased revenue during 2024", "did not open", "could reduce hiring if", "is currently not", "was completed last year", "litigation relating to", "may include a margin", "ongoing"]
TYPES = ["restructuring", "site_closure", "major_investment", "redundancy", "growth_language", "unknown"]


def _list(values: list[str], at: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({at}) % {len(values)} + 1]"


def _pick(values: list[str], at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


#: spans as z(doc_id, position, k, span).
SPANS = f"""{SENTENCES}, e as (select doc_id, s, unnest(range(len(s))) as position from x),
z as materialized (select doc_id, position::integer as position, doc_id + 5 * position as k, {_list(SUBJECTS, 'doc_id + 5 * position')} || ' ' || {_list(VERBS, 'doc_id + 7 * position')} || ' ' || regexp_replace(s[position + 1], '[^ -~]', '', 'g') as span from e)"""


def spans(t) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(ex.sentences(F.col("text"))).alias("position", "s"))
    place = lambda n: F.col("doc_id") + n * F.col("position")
    span = F.concat_ws(" ", _pick(SUBJECTS, place(5)), _pick(VERBS, place(7)), F.regexp_replace("s", "[^ -~]", ""))
    return rows.select("doc_id", "position", place(5).alias("k"), span.alias("span"))


def test(pattern: str, column: str = "span", flags: str = "i") -> str:
    """Whether a column has a pattern, in SQL; the pattern may bring its own flags."""
    return f"regexp_matches({column}, '{'' if pattern.startswith('(?') and flags == '' else f'(?{flags})'}{pattern.replace(chr(39), chr(39) * 2)}')"


def _plain(pattern: str) -> str:
    return test(pattern.removeprefix("(?i)"))


@query(f"""with {SPANS},
f as (select *, {_plain(ex.OWN)} as own, {_plain(ex.THIRD)} as third, {_plain(ex.ACTUAL)} as actual, {_plain(ex.PLANNED)} as planned from z),
g as (select *, case when own then 'target_company' when third then 'third_party' else 'unclear' end as entity from f),
h as (select *, case when {_plain(ex.BIOGRAPHY)} then 1 when {_plain(ex.ACCOUNTING)} then 2 when {_plain(ex.NEGATION)} then 3 when {_plain(ex.HISTORICAL)} and not planned then 4
 when {_plain(ex.HYPOTHETICAL)} and not actual then 5 when entity = 'third_party' then 6 when entity = 'unclear' and not actual and not planned then 7 else 8 end as rule from g)
select doc_id, position, entity, case when rule = 8 then 'accepted' when rule = 7 then 'ambiguous' else 'rejected' end as decision,
 case rule when 1 then 'background' when 2 then 'background' when 3 then 'negated' when 4 then 'historical' when 5 then 'hypothetical' when 6 then 'third_party' when 7 then 'ambiguous' else case when planned then 'planned' when contains(lower(span), 'ongoing') then 'ongoing' else 'current' end end as status,
 (['biography', 'accounting_or_definition', 'explicit_negation', 'historical_or_completed', 'generic_or_hypothetical_risk', 'wrong_entity', 'entity_or_factuality_unclear', null])[rule] as reason from h""")
def assessed_candidates(t):
    s = spans(t).select("doc_id", "position", F.col("span").alias("sentence"), F.col("span").alias("context"))
    return ex.assess(s).drop("sentence", "context")


#: Subjects, facts and states by the place of a span, in both forms.
WHO, FACT = ["target_company", "target_segment", "supplier", "target_subsidiary", "unknown"], ["actual_current", "generic_risk", "planned", "ambiguous", "actual_current", "hypothetical_risk", "actual_current"]
STATES = ["current", "planned", ""]
GIVEN = f"v as (select *, {_list(WHO, 'k')} as who, {_list(FACT, 'k')} as fact, {_list(STATES, 'k')} as st, {_list(TYPES, 'k')} as event_type from z)"


def given(t) -> DataFrame:
    k = F.col("k")
    return spans(t).withColumns({"subject_type": _pick(WHO, k), "factual_status": _pick(FACT, k), "event_status": _pick(STATES, k), "event_type": _pick(TYPES, k)})


def _cases(pairs) -> str:
    return " ".join(f"when {test(p, flags='is')} then '{code}'" for code, p in pairs)


VERIFIED = f"""case when fact in ('generic_risk', 'hypothetical_risk') then 'HYPOTHETICAL_ONLY' when who = 'unknown' then 'WRONG_ENTITY' when who = 'supplier' then 'THIRD_PARTY_ONLY' {_cases(la.EXCLUSIONS)}
 when length(span) < 25 or not regexp_matches(trim(span, ' '), '[.!?]$') then 'SOURCE_FRAGMENT_AMBIGUOUS' when who = 'target_segment' then 'DIRECT_SEGMENT_EVENT' when who = 'target_subsidiary' then 'DIRECT_SUBSIDIARY_EVENT' when st = 'planned' then 'DIRECT_PLANNED_EVENT' else 'DIRECT_CURRENT_EVENT' end"""
VERDICT = "case when code like 'DIRECT%' then 'accept' when code like '%AMBIGUOUS' then 'ambiguous' else 'reject' end"


@query(f"with {SPANS}, {GIVEN}, c as (select doc_id, position, {VERIFIED} as code from v) select doc_id, position, {VERDICT} as verdict, code from c")
def verified_candidates(t):
    return la.verify(given(t)).select("doc_id", "position", "verdict", "code")


@query(f"""with {SPANS}, {GIVEN},
p as (select *, who in ('target_company', 'target_segment', 'target_subsidiary') as subject, regexp_matches(trim(span, ' '), '[.!?]$') and len(list_filter(regexp_split_to_array(span, '\\s+'), lambda w: w <> '')) >= 5 and {test(la.EVENT_TERMS)} as predicate,
 (not {test(la.MIGHT)} or {test(la.DID)}) and fact not in ('generic_risk', 'hypothetical_risk') as actuality, st <> '' or {test(la.TIMING)} as timing, {test(la.EVENT_TERMS)} as fits from v),
c as (select *, case {_cases(la.GENERAL_EXCLUSIONS)} when not (subject and predicate and actuality and fits) then 'INSUFFICIENT_SUPPORT' when not timing then 'TIMING_AMBIGUOUS' else {VERIFIED} end as code from p)
select doc_id, position, subject, predicate, actuality, timing, fits, {VERDICT} as verdict, code from c""")
def sufficient_candidates(t):
    s = F.col("sufficiency")
    return la.verify_sufficient(given(t)).select("doc_id", "position", *(s[k].alias(k) for k in ("subject", "predicate", "actuality", "timing")), s["definition_fit"].alias("fits"), "verdict", "code")


@query(f"""with {SPANS}, v as (select *, regexp_extract(span, '(\\d+)', 1) as cell from z), g as (select doc_id, span, min(cell) as figure from v where k % 3 <> 0 and k % 5 <> 0 and cell <> '' group by all) select doc_id, span, figure, false as operational_event_promoted from g""")
def accounting_rows(t):
    rows = spans(t).withColumns({
        "disposition": F.when(F.col("k") % 3 == 0, "accepted").otherwise("rejected"),
        "status": F.when(F.col("k") % 5 == 0, "historical").otherwise("accounting_measure_only"),
        "cell_value": F.nullif(F.regexp_extract("span", r"(\d+)", 1), F.lit("")),
    })
    return la.accounting_observations(rows, ["doc_id"])


CONTEXTS = ["", "It was said by the company.", "A view of the market", "She served as an adviser."]
EXTERNAL_CASES = [
    ("customer_condition_with_explicit_company_impact", "cust and impact", "target_company", "direct", "group_or_unspecified"),
    ("customer_is_grammatical_subject", "cust", "customer", "external", "external"),
    ("supplier_cause_with_explicit_company_impact", f"{test(la.SUPPLIER)} and impact", "target_company", "direct", "group_or_unspecified"),
    ("supplier_is_grammatical_subject", test(la.SUPPLIER), "supplier", "external", "external"),
    ("competitor_is_grammatical_subject", test(la.COMPETITOR), "competitor", "external", "external"),
    ("industry_level_statement", test(la.INDUSTRY), "industry", "external", "sector"),
    ("named_third_party_is_subject", "third is not null", "third_party", "external", "external"),
    ("joint_venture_subject", test(la.JOINT_VENTURE), "joint_venture", "external_or_shared", "joint_venture"),
    ("acquisition_target_subject", test(la.ACQUISITION_TARGET), "acquisition_target", "external", "external"),
    ("controlled_subsidiary_reference", test(la.SUBSIDIARY), "target_subsidiary", "direct", "subsidiary"),
    ("named_target_segment", "segment is not null", "target_segment", "direct", "segment"),
    ("issuer_reference", f"{test(la.ISSUER)} or {test(la.ISSUER, 'context')}", "target_company", "direct", "group_or_unspecified"),
    ("factual_filing_clause_without_external_subject", test(la.ACTUAL), "target_company", "inferred", "group_or_unspecified"),
]
SUBJECT_CASES = [("biography_or_career_history", test(la.BIOGRAPHY, "both_"), "former_employer", "external", "external"), ("third_party_quote", test(la.QUOTE), "third_party", "external", "external"), *EXTERNAL_CASES]
TOLD = "case reason " + "{}" + " end"
BY_REASON = [" ".join(f"when '{c[0]}' then '{c[n]}'" for c in SUBJECT_CASES) for n in (2, 3, 4)]
FACTS = f"""case when {test(la.PLAN)} then 'planned' when {test(la.BEFORE)} then 'actual_historical' when {test(la.GENERIC_RISK)} and not {test(la.IMPACT)} and not {test(la.EMBEDDED)} and not {test(la.AT_TIMES)} then 'generic_risk'
 when {test(la.MODAL)} and not {test(la.ACTUAL)} then 'hypothetical_risk' when {test(la.ACTUAL)} and {test(la.MODAL)} then 'actual_current_with_forecast' when {test(la.ACTUAL)} then 'actual_current' else 'ambiguous' end"""


@query(f"""with {SPANS}, v as (select *, {_list(CONTEXTS, 'k')} as context from z),
w as (select *, context || ' ' || span as both_, {test(la.IMPACT)} as impact, {test(la.CUSTOMER_BENEFIT)} or {test(la.CUSTOMER)} as cust, nullif(trim(regexp_extract(span, '(?i){la.SEGMENT}', 1), ' '), '') as segment,
 case when not regexp_matches(span, '^\\s*(?:we\\b|our\\b|the company\\b|the group\\b)') then nullif(regexp_extract(span, '^\\s*([A-Z][A-Za-z&.-]+) (?:plans?|announced|expects?) to\\b', 1), '') end as third from v),
r as (select *, case {' '.join(f"when {c[1]} then '{c[0]}'" for c in SUBJECT_CASES)} else 'subject_not_resolved' end as reason from w)
select doc_id, position, coalesce({TOLD.format(BY_REASON[0])}, 'unknown') as subject_type, coalesce({TOLD.format(BY_REASON[1])}, 'unclear') as relevance, coalesce({TOLD.format(BY_REASON[2])}, 'unknown') as scope, reason as subject_reason,
 case reason when 'named_third_party_is_subject' then third when 'named_target_segment' then segment end as subject_entity, case reason when 'named_target_segment' then segment end as segment_name, {FACTS} as factual_status from r""")
def attributed_subjects(t):
    rows = spans(t).withColumn("context", _pick(CONTEXTS, F.col("k")))
    return la.attribute_subject(rows).drop("k", "span", "context")


SUBJECT_KINDS = ["target_company", "supplier", "unknown", "customer", "target_segment", "target_company", "joint_venture", "target_company", "target_subsidiary", "target_company", "target_company"]
EVENT_KINDS = ["labour_constraint", "restructuring", "supply_chain_constraint"]
FACT_KINDS = ["actual_current", "generic_risk", "planned", "hypothetical_risk", "actual_historical", "ambiguous", "actual_current"]


@query(f"""with {SPANS}, v as (select *, {_list(SUBJECT_KINDS, 'k')} as s, {_list(EVENT_KINDS, 'k')} as e, {_list(FACT_KINDS, 'k')} as f from z),
w as (select *, case when e in ('labour_constraint', 'supply_chain_constraint') and ({test(la.SUPPLIER)} or {test(la.SUPPLIER_LABOUR)}) then 'supplier' else s end as who from v),
r as (select *, case when {test(la.TECHNICAL_REDUNDANCY)} then 'technical_redundancy_not_workforce_event' when {test(la.PAGE_JOIN)} and length(span) > 280 then 'joined_page_table_fragment' when {test(la.ACCOUNTING_CONTEXT)} then 'accounting_definition_or_cross_reference'
 when {test(la.EQUITY_METHOD)} then 'external_equity_method_or_affiliate_context' when e = 'labour_constraint' and {test(la.SUPPLIER_LABOUR)} and not {test(la.IMPACT)} then 'supplier_labour_condition_without_target_labour_event'
 when who in ('supplier', 'customer', 'joint_venture') then 'external_subject:' || who when who = 'unknown' then 'subject_unresolved' when f in ('generic_risk', 'hypothetical_risk') then f when f = 'actual_historical' then 'historical_condition' else 'acceptance_contract_satisfied' end as reason from w)
select doc_id, position, who as subject_type, case reason when 'acceptance_contract_satisfied' then 'accepted' when 'subject_unresolved' then 'ambiguous' else 'rejected' end as decision, reason as decision_reason from r""")
def accepted_candidates(t):
    k = F.col("k")
    rows = spans(t).withColumns({"subject_type": _pick(SUBJECT_KINDS, k), "event_type": _pick(EVENT_KINDS, k), "factual_status": _pick(FACT_KINDS, k)})
    return la.acceptance(rows).select("doc_id", "position", "subject_type", "decision", "decision_reason")


#: Ends that word an event of every family, so that all verifiers have something to accept.
ENDS = ["", "our backlog grew by much this year", "we announced a headcount reduction for many roles", "the group closed two plants", "our deliveries were disrupted", "we recalled a product", "the chief executive resigned", "we implemented a cost reduction plan", "we are hiring engineers", "we might see demand grow", "the safety incident caused a stop", "capacity expansion announced for the new line", "no restructuring was announced", "in the past revenue grew", "expenses increased and growth slowed"]
ROUTED = [*la.FAMILIES, "unknown"]
FAMILY_SQL = "case event_type " + " ".join(f"when '{e}' then '{f}'" for e, f in la.FAMILIES.items()) + " end"
OWN_SUPPORT = {**la.SUPPORT, **{t: la.SUPPORT[k] for t, k in la.SAME_SUPPORT.items()}}
FAMILY_NAMES = list(dict.fromkeys(la.FAMILIES.values()))
BY_TYPE = " ".join(f"when '{e}' then {test(p, 'body')}" for e, p in OWN_SUPPORT.items() if e not in FAMILY_NAMES or e == "demand_growth")
BY_FAMILY = " ".join(f"when '{f}' then {test(OWN_SUPPORT[f], 'body')}" for f in FAMILY_NAMES if f in OWN_SUPPORT)
REFUSED = " ".join(f"when family = '{f}' and {test(p, 'body')}{'' if unless is None else ' and not ' + test(unless, 'body')} then 'reject:{reason}'" for f, refusals in la.REFUSALS.items() for p, unless, reason in refusals)
ACCRUED = f"({test(la.ACCRUAL, 'body')} and {test(la.ACCRUAL_USE, 'body')})"
GOOD, LEFT_OPEN = (" ".join(f"when '{f}' then '{r[n]}'" for f, r in la.REASONS.items()) for n in (0, 1))


@query(f"""with {SPANS}, v as (select *, {_list(ROUTED, 'k')} as event_type, {_list(['target_company', 'target_segment', 'supplier', 'target_company'], 'k')} as who, {_list(ENDS, 'doc_id + 11 * position')} as tail from z),
w as (select *, case when k % 37 = 0 then ' ' when tail = '' then span else tail || ' ' || span end as body, {FAMILY_SQL} as family from v),
p as materialized (select *, coalesce(case event_type {BY_TYPE} else case family {BY_FAMILY} end end, false) as plain from w),
s as (select *, case family when 'restructuring_cost_action' then ({test(la.IDENTITY, 'body')} and {test(la.ACTION, 'body')}) or {test(la.INDIRECT, 'body')} or {ACCRUED} when 'supply_chain_resilience' then plain or {test(la.CONTINUING, 'body')} else plain end as supported from p),
r as (select *, case when family is null then 'ambiguous:family_not_implemented' when trim(body, ' ') = '' then 'reject:missing_exact_provenance' when k % 31 = 0 then 'reject:heading_only' when who = 'supplier' then 'reject:wrong_entity' when {test(la.NEGATED, 'body')} then 'reject:negated_event'
 when {test(la.HYPOTHETICAL, 'body')} and not {test(la.HAPPENED, 'body')} then 'reject:hypothetical_only' when {test(la.LONG_AGO, 'body')} and not {test(la.STILL, 'body')} then 'reject:historical_only' when {test(la.FORMER, 'body')} and {test(la.ENDED, 'body')} then 'reject:historical_only' {REFUSED}
 when family = 'restructuring_cost_action' and {test(la.PROVISION, 'body')} and not {test(la.ACTION, 'body')} and not {ACCRUED} then 'ambiguous:accounting_reference_without_action' when supported then 'accept:' || case family {GOOD} end else 'ambiguous:' || case family {LEFT_OPEN} end end as told from s)
select doc_id, position, coalesce(family, 'unrouted') as family, split_part(told, ':', 1) as disposition, split_part(told, ':', 2) as reason from r""")
def family_verdicts(t):
    k = F.col("k")
    tail = _pick(ENDS, F.col("doc_id") + 11 * F.col("position"))
    rows = spans(t).withColumns({"event_type": _pick(ROUTED, k), "subject_type": _pick(["target_company", "target_segment", "supplier", "target_company"], k), "heading_only": k % 31 == 0})
    body = F.when(k % 37 == 0, " ").when(tail == "", F.col("span")).otherwise(F.concat(tail, F.lit(" "), F.col("span")))
    return la.verify_family(rows.withColumn("span", body)).select("doc_id", "position", "family", "disposition", "reason")


KINDS = ["DUPLICATE_EVENT", "AMBIGUOUS", "MISSED_EVENT", "FALSE_POSITIVE", "OTHER", "MISSED_EVENT", "FALSE_POSITIVE"]


def _words(*words: str) -> str:
    return "(" + " or ".join(f"contains(lower(span), '{w}')" for w in words) + ")"


@query(f"""with {SPANS}, {GIVEN}, w as (select *, {_list(KINDS, 'k')} as kind from v)
select doc_id, position, case when kind = 'DUPLICATE_EVENT' then 'duplicate' when {_words('served as', 'career', 'where she worked')} then 'biography' when {_words('redundancy and other continuity', 'as a simplification')} then 'taxonomy_overreach'
 when {_words('may include', 'assumptions about')} then 'generic_boilerplate' when {_words(' may ', ' could ', ' if ', 'risk of')} then 'hypothetical_risk' when kind = 'AMBIGUOUS' then 'incomplete_source' when kind = 'MISSED_EVENT' then 'synonym_or_phrase_structure_missing'
 when kind = 'FALSE_POSITIVE' then 'contextual_false_positive' else 'unadjudicated_plausible_ai_omission' end as failure_class,
 case when kind = 'MISSED_EVENT' then 'accepted' when kind in ('FALSE_POSITIVE', 'DUPLICATE_EVENT') then 'rejected' else 'ambiguous' end as expected,
 case when kind = 'MISSED_EVENT' and event_type = 'major_investment' then 'planned' when kind = 'MISSED_EVENT' then 'current_or_ongoing' when kind in ('FALSE_POSITIVE', 'DUPLICATE_EVENT') then 'hypothetical_or_irrelevant' else 'requires_human_adjudication' end as expected_status from w""")
def failure_classes(t):
    rows = given(t).withColumn("classification", _pick(KINDS, F.col("k")))
    return la.failure_class(rows).select("doc_id", "position", "failure_class", "expected", "expected_status")


FAMILY, WHEN, POLARITY = ["supply_chain_resilience", "workforce", "delivery_capacity_sites", "leadership_change_execution"], ["historical", "hypothetical", "unknown", "current", "planned"], ["positive", "none", "mixed", "unclear", "negative", "other", "neutral"]
NAMED = " ".join(f"when '{k}' then '{v}'" for k, v in la.CATEGORY_NAMES.items())
TIMED = {"historical_vs_current": " or w in ('historical', 'current', 'ongoing')", "hypothetical_vs_actual": " or w = 'hypothetical'"}


@query(f"""with {SPANS}, v as (select *, {_list(FAMILY, 'k')} as f, {_list(WHEN, 'k')} as w, {_list(POLARITY, 'k')} as p from z)
select doc_id, position, array_to_string(list_sort(list_filter(['event_identity_ambiguity', {', '.join(f"case when {test(p)}{TIMED.get(n, '')} then '{n}' end" for n, p in la.CATEGORIES)}, case when p in ('positive', 'negative', 'neutral', 'unclear') then 'polarity_ambiguity' end, case f {NAMED} else f end], lambda x: x is not null)), ',') as categories from v""")
def ambiguous_categories(t):
    k = F.col("k")
    rows = spans(t).withColumns({"context": F.lit(""), "family": _pick(FAMILY, k), "timing": _pick(WHEN, k), "polarity": _pick(POLARITY, k)})
    return la.ambiguity_categories(rows).select("doc_id", "position", F.array_join("categories", ",").alias("categories"))


@query(f"""with {SPANS}, v as (select *, case when k % 6 = 0 then substr(span, 4, 20) || '#' else substr(span, 4, 20) end as cut, nullif(k % 7, 0) as subject, nullif(k % 11, 0) as action, {_list(['unclear', 'own', 'own'], 'k')} as entity, 100 * position as zone_start from z),
w as (select *, instr(span, cut) as found from v)
select doc_id, position, case when found = 0 or subject is null or action is null then 'reject' when k % 13 = 0 or entity = 'unclear' then 'ambiguous' else 'accept' end as verdict, (case when found > 0 then zone_start + found - 1 end)::integer as start, (case when found > 0 then zone_start + found - 1 + length(cut) end)::integer as stop, 'fact-' || substr(sha256(span || '|' || cut), 1, 16) as fact_id from w""")
def validated_facts(t):
    k = F.col("k")
    some = F.substring("span", 4, 20)
    rows = spans(t).select(
        "doc_id",
        "position",
        F.col("span").alias("zone"),
        (100 * F.col("position")).alias("zone_start"),
        F.when(k % 6 == 0, F.concat(some, F.lit("#"))).otherwise(some).alias("span"),
        F.nullif(k % 7, F.lit(0).cast("long")).alias("subject"),
        F.nullif(k % 11, F.lit(0).cast("long")).alias("action"),
        F.lit("x").alias("object"),
        F.when(k % 13 != 0, _pick(["unclear", "own", "own"], k)).alias("entity"),
    )
    return ex.validate_facts(rows).select("doc_id", "position", "verdict", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "fact_id")


@query("""with d as (select doc_id, '“' || coalesce(text, '') || '”' || chr(7) || chr(9) || '‘x’  ' || chr(160) || '½ Å' as body from documents),
n as (select doc_id, nfc_normalize(replace(replace(translate(body, '“”‘’', '""''''' || ''''''), '½', '1⁄2'), chr(160), ' ')) as body from d)
select doc_id, sha256(trim(regexp_replace(regexp_replace(body, '[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f]', '', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'), ' ')) as visible_sha256 from n""")
def visible_source(t):
    d = F.concat(F.lit("“"), F.coalesce("text", F.lit("")), F.lit("”\x07\t‘x’   ½ Å"))
    return t.documents.select("doc_id", F.sha2(tx.visible_source_text(d), 256).alias("visible_sha256"))


#: One more look at the users of each event type: who was there before, and who is there now.
BEFORE = "select event_type, user_id as identity, 'Engineer ' || (user_id % 9) as title, 'Town ' || (user_id % 2) as location, case when user_id % 3 = 0 then 'closed' else 'open' end as status, case when user_id % 3 = 0 then 2 else (user_id % 2)::integer end as misses from events where ts::date < date '2024-01-20' group by all"
NOW = "select event_type, user_id as identity, 'Engineer ' || (user_id % 9) as title, 'town ' || (user_id % 2) as location from events where ts::date >= date '2024-01-20' and (event_type <> 'error' or user_id % 50 = 0) group by all"


@query(f"""with b as ({BEFORE}), o as ({NOW}),
h as (select k.event_type, not coalesce(x.n >= 5 and 1 - coalesce(y.n, 0) / x.n >= 0.8, false) as healthy from (select event_type from b union select event_type from o) k left join (select event_type, count(*) as n from b where status = 'open' group by 1) x using (event_type) left join (select event_type, count(*) as n from o group by 1) y using (event_type)),
j as (select coalesce(b.event_type, o.event_type) as event_type, coalesce(b.identity, o.identity) as identity, b.status as old, b.misses as was, o.identity is not null as seen, b.title as bt, b.location as bl, o.title as ot, o.location as ol from b full join o on b.event_type = o.event_type and b.identity = o.identity),
s as (select j.*, healthy, case when healthy and seen then ot else bt end as title, case when healthy and seen then ol else bl end as location,
 case when not healthy then old when seen then 'open' when old = 'open' and was + 1 >= 2 then 'closed' else old end as status, case when not healthy then was when seen then 0 when old = 'open' then was + 1 else was end as misses from j join h using (event_type) where healthy or old is not null),
c as (select event_type, lower(title) as t, lower(location) as l, max(identity) as id from s where status = 'closed' group by all)
select s.event_type, s.identity::varchar as identity, s.title, s.location, s.status, s.misses::integer as misses, case when s.old is null then c.id end::varchar as repost_of, s.healthy from s left join c on c.event_type = s.event_type and c.t = lower(s.title) and c.l = lower(s.location)""")
def job_states(t):
    u, late = F.col("user_id"), F.to_date("ts") >= F.lit("2024-01-20").cast("date")
    title = F.concat(F.lit("Engineer "), (u % 9).cast("string")).alias("title")
    town = lambda name: F.concat(F.lit(f"{name} "), (u % 2).cast("string")).alias("location")
    before = t.events.where(~late).select("event_type", u.alias("identity"), title, town("Town"), F.when(u % 3 == 0, "closed").otherwise("open").alias("status"), F.when(u % 3 == 0, 2).otherwise((u % 2).cast("int")).alias("misses")).distinct()
    now = t.events.where(late & ((F.col("event_type") != "error") | (u % 50 == 0))).select("event_type", u.alias("identity"), title, town("town")).distinct()
    return lc.job_states(before, now, ["event_type"]).withColumn("identity", F.col("identity").cast("string")).withColumn("repost_of", F.col("repost_of").cast("string"))


#: Who is seen each day; on every ninth day few are, and every seventh fails.
OUTAGES = """g as (select distinct event_type as source, (user_id % 40)::varchar as identity, ts::date as ts from events), s as (select * from g where extract(day from ts) % 9 <> 4 or identity = '0'),
n as (select source, ts, extract(day from ts) % 7 <> 3 as ok, row_number() over (partition by source order by ts) as k from (select distinct source, ts from g)),
z as (select n.*, (select count(*) from s where s.source = n.source and s.ts = n.ts) as seen from n), q as (select s.source, n.k, identity from s join n using (source, ts)),
r as (select source, k from n union all select distinct source, 0 from n), u as (select a.source, a.k as a, b.k as b, (select count(distinct identity) from q where q.source = a.source and q.k in (a.k, b.k)) as n from r a join r b on a.source = b.source and b.k <= a.k and b.k >= a.k - 12)"""


@query(f"""with recursive {OUTAGES},
w(source, k, p1, p2, health) as (select distinct source, 0::bigint, 0::bigint, 0::bigint, '' from n
union all select y.source, y.k, case when y.h = 'healthy' then y.k else y.p1 end, case when y.h = 'healthy' then y.p1 else y.p2 end, y.h from (
 select z.source, z.k, w.p1, w.p2, case when not z.ok then 'fetch_failed' when u.n >= 10 and z.seen <= u.n * 0.2 then 'suspicious_drop' else 'healthy' end as h from w join z on z.source = w.source and z.k = w.k + 1 join u on u.source = w.source and u.a = w.p1 and u.b = w.p2) y),
m as (select source, k, row_number() over (partition by source order by k) as i from w where health = 'healthy'),
a as (select q.source, identity, i, i - lag(i) over (partition by q.source, identity order by i) as gap from q join m using (source, k)), l as (select source, max(i) as last from m group by 1),
p as (select source, identity, max(i) as m, count(*) filter (gap > 2) as reopened from a group by all)
select source, identity, case when last - m >= 2 then 'closed' else 'open' end as status, least(last - m, 2)::integer as misses, reopened::integer as reopened from p join l using (source)""")
def lifecycle_outages(t):
    day = F.dayofmonth("ts")
    e = t.events.select(F.col("event_type").alias("source"), (F.col("user_id") % 40).cast("string").alias("identity"), F.to_date("ts").alias("ts"))
    few = (day % 9 == 4) & (F.col("identity") != "0")
    looks = e.groupBy("source", "ts").agg((F.first(day) % 7 != 3).alias("success"), F.collect_set(F.when(~few, F.col("identity"))).alias("identities"))
    return judged.lifecycle_states(looks, ["source"])
