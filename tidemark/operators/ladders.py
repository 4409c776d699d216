"""Ordered rules on candidate sentences: structure, tables, subjects, verifiers and event families.

A candidate has `span`, and where a rule needs them `context`, `heading`, `event_type`, `event_status`,
`subject_type`, `factual_status`, `report_year`, `heading_only`, `accounting_table_only`. Each operator adds
columns; no row is lost. Rules are data: lists of (test, result) of which the first that holds decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of accounting rows, tables, and what promotes them to events.
ACCOUNTING_EVENTS = ["restructuring", "redundancy", "site_closure", "transformation"]
PROMOTION = r"\b(?:during (?:20\d{2}|the current (?:quarter|year|period)) we (?:initiated|announced|commenced)|in the current (?:quarter|year|period) we (?:initiated|announced|commenced)|we (?:initiated|announced|commenced|implemented)|the company (?:is implementing|announced)|effective 20\d{2}|current programme includes|(?:initiated|commenced|implemented) (?:a |the )?(?:restructuring|site closure|workforce reduction))\b"
HISTORICAL = r"\b(?:prior restructuring actions?|previously announced|completed in (?:a )?prior year|historical restructuring|legacy programme|prior-year initiative|remaining costs associated with|implementation of (?:a )?previously announced plan|in 20(?:0\d|1\d|2[0-3]) and 20\d{2})\b"
ACCOUNTING_ROW = r"\b(?:restructuring (?:charges?|costs?|provisions?)|impairment charges?|employee separations?|contract terminations?|long-lived asset impairments?|adjusted|gaap|segment profit|corporate items and eliminations|effective tax rate|costs? related to (?:our )?restructuring)\b"
NON_EVENT = r"\btroubled debt restructur(?:ing|ings|e|ed)\b"
MONITOR = r"\b(?:continue to monitor|monitoring)\b"
OCCURRED = r"\b(?:experienced|caused|resulted|affected)\b"
OFFSET = r"\bif we are unable to (?:fully )?offset\b"
TABLE_MARKS = r"(?:\btable of contents\b|\(millions? of dollars\)|\bnine months ended\b|\bthree months ended\b|\b% change\b|\b20\d{2}\s+20\d{2}\b)"
PAGE_HEAD = r"^\s*\d{1,3}\s+table of contents\b"
FIGURE = r"((?<![A-Za-z])\(?[-+$£€]?\d[\d,.]*%?\)?)"
# Wording that names a subject.
BIOGRAPHY = r"\b(?:biograph|served as|previously (?:served|led|worked)|career at|former employer|began (?:his|her|their) career|appointed to the board)\b"
QUOTE = r"\b(?:according to|analysts? (?:said|expect)|a customer said|a supplier said|the regulator said)\b"
CUSTOMER = r"\b(?:our |the )?customers? (?:experienced|face|faced|may|might|could|can|plan|announced|reduced|have|has|desire)\b"
CUSTOMER_BENEFIT = r"\b(?:cost reductions? for our customers|customers?.{0,120}cost reductions?)\b"
SUPPLIER = r"\b(?:our |the )?(?:suppliers?|vendors?) (?:experienced|face|faced|may|might|could|can|plan|announced|expanded|reduced)\b"
COMPETITOR = r"\b(?:our |the )?competitors? (?:experienced|face|faced|may|could|plan|announced)\b"
INDUSTRY = r"\b(?:the|our) (?:industry|sector|market)|industry participants|many other employers\b"
THIRD_PARTY_PLAN = r"^\s*(?!we\b|our\b|the company\b|the group\b)([A-Z][A-Za-z&.-]+) (?:plans?|announced|expects?) to\b"
JOINT_VENTURE = r"\b(?:joint venture|associate company)\b"
ACQUISITION_TARGET = r"\bacquisition target\b"
SUBSIDIARY = r"\b(?:our|the company's|the group’s|the group's) (?:controlled )?subsidiary\b"
SEGMENT = r"\b(?:our |the )?([A-Z][A-Za-z& ]{2,40}) (?:segment|division|business unit)\b"
ISSUER = r"\b(?:we|our|us|the company|the group|company's|group's)\b"
IMPACT = r"\b(?:caused|causing|resulted in|reduced|delayed|constrained|disrupted|affected|impact(?:ed|ing)) (?:our|the company's|the group’s|the group's) (?:production|output|sales|volume|operations|deliveries|business)\b"
# Wording of factual status.
MODAL = r"\b(?:may|might|could|can|would|should|potentially|risk of|possibility of|subject to|if)\b"
ACTUAL = r"\b(?:currently|during the (?:quarter|period)|experienced|experiencing|has experienced|have experienced|declined|decreased|reduced|constrained|disrupted|delayed|paused|increased|announced|initiated|implemented|are at times subject to)\b"
PLAN = r"\b(?:plan|plans|planned|expect to|announced)\b"
BEFORE = r"\b(?:prior year|previously)\b"
EMBEDDED = r"\bafter (?:having )?(?:declined|decreased|falling).{0,60}\b(?:quarter|period|year)\b"
AT_TIMES = r"\bare at times subject to\b"
GENERIC_RISK = r"\b(?:other factors, including|can fluctuate|may face|could result|mitigate the risks? of|sensitive to general economic conditions|the closure of .* involves|if .* were to|are subject to|could adversely affect|enable us to capture revenue growth|future revenue growth rates|shortages persist broadly|classified as essential.{0,100}facility closures?)\b"
# Wording that the acceptance contract refuses.
TECHNICAL_REDUNDANCY = r"\b(?:database|system|server|network).{0,100}\bredundan"
PAGE_JOIN = r"(?:^\s*\d+\s+table of contents\b|form 10-k table of contents)"
ACCOUNTING_CONTEXT = r"\b(?:relate to, among other things|corporate includes|for purposes of business segment performance|excluding .{0,80}(?:restructuring|integration|divestiture) costs?|estimates? require judgment of future revenue growth|see note \d+ .{0,80}additional information)\b"
EQUITY_METHOD = r"\b(?:equity method investment|unconsolidated affiliate)\b"
SUPPLIER_LABOUR = r"\bsupplier.{0,100}\blabou?r shortages?\b"
EXTERNAL = ["supplier", "customer", "competitor", "industry", "third_party", "former_employer", "acquisition_target", "joint_venture"]
TARGETS = ["target_company", "target_segment", "target_subsidiary"]
# Exclusions of the verifiers, in order.
EXCLUSIONS = [
    ("LEGAL_REFERENCE", r"\b(?:litigation|lawsuits?|legal proceedings?|claims? alleging)\b"),
    ("CROSS_REFERENCE_ONLY", r"^\s*(?:see|refer to) (?:note|the section|item)\b"),
    ("ACCOUNTING_DEFINITION", r"\b(?:represent gross reductions|for accounting purposes|are defined as|(?:restructuring|impairment) (?:costs|charges) consist of)\b"),
    ("HEADING_ONLY", r"^\s*(?:cost savings plans?|restructuring(?: costs| charges)?|component shortages)\.?\s*$"),
    ("GENERIC_RISK", r"\b(?:may be subject to|could affect|often increases during periods|risk of)\b"),
    ("MALFORMED_FRAGMENT", r"^(?:\s*table of contents\s*)$|\byear in review\b.{0,80}\$\d"),
]
GENERAL_EXCLUSIONS = [
    ("HEADING_ONLY", r"^\s*(?:\(?\d+\)?\s*)?(?:cost savings plans?|restructuring|site closures?|capacity|pricing pressure)\.?\s*$"),
    ("LEGAL_REFERENCE", r"\b(?:claims and actions arising from|legal proceedings? (?:include|involve)|litigation relating to)\b"),
    ("ACCOUNTING_DEFINITION", r"\b(?:represent(?:s)? gross reductions|is defined as|are defined as|for accounting purposes|means the amount|consist(?:s)? of charges)\b"),
    ("THIRD_PARTY_ONLY", r"\b(?:the global economy|the industry|competitors?|quoted analyst|the customer|the supplier)\b.{0,100}\b(?:experienced|announced|closed|restructured|disruption)\b"),
    ("GENERIC_RISK", r"\b(?:may be subject to|could be affected by|risk of|possibility of|may adversely affect)\b"),
    ("WRONG_CONTEXT", r"\b(?:operating expenses?|costs?)\b.{0,80}\b(?:grew|growth|increased)\b|\bnet revenue growth has been impacted\b"),
]
# Wording of sufficiency.
MIGHT = r"\b(?:may|might|could|would|risk of|possibility of|if (?:we|the company|the group))\b"
DID = r"\b(?:experienced|occurred|reduced|increased|declined|initiated|implemented|closed|opened|paused)\b"
EVENT_TERMS = r"\b(?:restructur|clos|open|expand|reduc|increase|declin|deteriorat|improv|pressure|constraint|disrupt|programme|program|backlog|capacity|hiring|vacanc|margin|revenue|price|pricing)\w*\b"
TIMING = r"\b(?:during|in|since|currently|ongoing|this year|the year|quarter|month|planned|announced|completed|previously)\b"


#: Wording in lower case of which every match of a pattern has some; a text without it is not searched for the pattern.
NEEDS = {
    BIOGRAPHY: ["biograph", "served as", "previously ", "career", "former employer", "appointed to the board"],
    QUOTE: ["according to", "analyst", " said"],
    CUSTOMER: ["customer"],
    CUSTOMER_BENEFIT: ["cost reduction"],
    SUPPLIER: ["supplier", "vendor"],
    COMPETITOR: ["competitor"],
    INDUSTRY: ["industry", " sector", " market", "many other employers"],
    JOINT_VENTURE: ["joint venture", "associate company"],
    ACQUISITION_TARGET: ["acquisition target"],
    SUBSIDIARY: [" subsidiary"],
    SEGMENT: [" segment", " division", " business unit"],
    IMPACT: [" our ", " the company's ", " the group"],
    PLAN: ["plan", "expect to", "announced"],
    BEFORE: ["prior year", "previously"],
    EMBEDDED: ["after "],
    AT_TIMES: ["are at times subject to"],
}

#: The letters that a match of a pattern begins with; elsewhere it is not tried.
STARTS = {ISSUER: "woutcg", MODAL: "mcwspri", ACTUAL: "cdehrpia", GENERIC_RISK: "ocmstiaef"}


def may_have(low: str, pattern: str) -> Column:
    """Whether a text, given in lower case, has what the pattern needs."""
    return reduce(lambda a, b: a | b, (F.contains(F.col(low), F.lit(w)) for w in NEEDS[pattern]))


def has(text: Column | str, pattern: str, over_lines: bool = False, low: str | None = None) -> Column:
    """Whether the text has the pattern, whatever the case; false for null. A dot meets line ends only if `over_lines`.

    `low` names a column with the text in lower case, in which what the pattern needs is looked for first.
    """
    ahead = f"(?=[{STARTS[pattern]}{STARTS[pattern].upper()}])" if pattern in STARTS else ""
    found = F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(ahead + ("(?is)" if over_lines else "(?i)") + pattern), F.lit(False))
    return may_have(low, pattern) & found if low and pattern in NEEDS else found


def row(values: Sequence, names: Sequence[str]) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v).cast("string")).alias(n) for n, v in zip(names, values)))


def first_of(rules: Sequence[tuple[Column, Sequence | Column]], default: Sequence, names: Sequence[str]) -> Column:
    """The struct of the first rule whose test holds; a rule has its values, or a struct of them."""
    as_row = lambda values: values if isinstance(values, Column) else row(values, names)
    return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), as_row(rule[1])).otherwise(rest), reversed(rules), as_row(default))


def _years(span: str) -> Column:
    return F.transform(F.regexp_extract_all(span, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def malformed(span: str) -> Column:
    """Unmatched brackets, repeated headings, figures without words, or a page's head."""
    count = lambda p: F.regexp_count(span, F.lit(p))
    figures = count(FIGURE)
    brackets = F.length(F.replace(F.col(span), F.lit("("), F.lit(""))) != F.length(F.replace(F.col(span), F.lit(")"), F.lit("")))
    return brackets | (count(r"(?i)\b(?:adjusted|gaap|20\d{2}|table of contents)\b") >= 5) | ((figures >= 5) & (count("[A-Za-z]+") < 2.5 * figures)) | has(span, PAGE_HEAD)


def structure(df: DataFrame, span: str = "span") -> DataFrame:
    """`df` with structure_type, structure_quality, period_binding, row_label, cell_value (G9); report_year may be null."""
    year, years = F.col("report_year"), _years(span)
    table = has(span, TABLE_MARKS) | (has(span, ACCOUNTING_ROW) & (F.regexp_count(span, F.lit(FIGURE)) >= 2))
    note = has(span, r"\b(?:represents|related to|primarily|included|consist)\b")
    kind = first_of(
        [
            (malformed(span), ("malformed_unknown_fragment", "low")),
            (has(span, r"^\s*[•*-]"), ("list_bullet", "high")),
            ((table | has(span, r"^\s*\d+\s+")) & note, ("table_footnote", "medium")),
            (table, ("table_row", "medium")),
        ],
        ("narrative_sentence", "high"),
        ("structure_type", "structure_quality"),
    )
    named = F.size(years) > 0
    now, past = F.array_contains(years, year), F.exists(years, lambda y: y < year)
    period = first_of(
        [
            (now & past, ("current_and_comparative",)),
            (named & ~F.exists(years, lambda y: y >= year), ("comparative_period",)),
            (named & ~F.exists(years, lambda y: y <= year), ("future_period",)),
            (now, ("current_period",)),
            (F.size(F.array_distinct(years)) > 1, ("multi_year_history",)),
            (named, ("explicit_single_period",)),
        ],
        ("unknown",),
        ("p",),
    )["p"]
    blank = lambda c: F.nullif(c, F.lit(""))
    out = df.withColumn("_k", kind).withColumn("period_binding", period)
    return out.select(*df.columns, "_k.structure_type", "_k.structure_quality", "period_binding", blank(F.regexp_extract(span, f"(?i)({ACCOUNTING_ROW})", 1)).alias("row_label"), blank(F.regexp_extract(span, FIGURE, 1)).alias("cell_value"))


def table_disposition(df: DataFrame, span: str = "span") -> DataFrame:
    """`structure` of the rows, and disposition, status, disposition_reason (G10): accounting rows are no events unless wording of a current action promotes them."""
    d = structure(df, span)
    years, year = _years(span), F.col("report_year")
    low, own = F.col("structure_quality") == "low", F.col("event_type").isin(*ACCOUNTING_EVENTS)
    least, most = F.array_min(years), F.array_max(years)
    promoted = has(span, PROMOTION)
    rules = [
        (has(span, NON_EVENT), ("rejected", "accounting_measure_only", "accounting_term_not_operational_event")),
        (has(span, OFFSET), ("rejected", "hypothetical", "conditional_cost_offset_not_cost_reduction_event")),
        (has(span, MONITOR) & ~has(span, OCCURRED), ("ambiguous", "ambiguous", "monitoring_statement_without_direct_occurrence")),
        ((least < year) & (year < most), ("rejected", "ambiguous", "mixed_period_table_fragment")),
        (has(span, PAGE_HEAD) & (F.length(span) > 400), ("rejected", "ambiguous", "page_header_joined_to_unrelated_text")),
        (low & (F.length(span) > 600), ("rejected", "ambiguous", "malformed_table_fragment")),
        (has(span, HISTORICAL) | F.coalesce(most < year, F.lit(False)), ("rejected", "historical", "historical_or_comparative_disclosure")),
        (low & own, ("rejected", "ambiguous", "malformed_table_fragment")),
        (own & has(span, ACCOUNTING_ROW) & ~promoted, ("rejected", "accounting_measure_only", "financial_observation_not_operational_event")),
        (F.col("structure_type").startswith("table") & own & ~promoted, ("ambiguous", "ambiguous", "table_period_or_operational_support_unclear")),
    ]
    pick = first_of(rules, ("accepted", F.col("event_status"), "current_operational_support"), ("disposition", "status", "disposition_reason"))
    return d.withColumn("_d", pick).select(*d.columns, "_d.*")


def accounting_observations(df: DataFrame, keys: Sequence[str], span: str = "span") -> DataFrame:
    """keys, span, figure, operational_event_promoted: accounting rows that are no events, once for each span."""
    rows = df.where((F.col("disposition") == "rejected") & (F.col("status") == "accounting_measure_only") & F.col("cell_value").isNotNull())
    return rows.groupBy(*keys, span).agg(F.min("cell_value").alias("figure")).withColumn("operational_event_promoted", F.lit(False))


def factual_status(span: str = "span", low: str | None = None) -> Column:
    """Whether a sentence tells a plan, the past, a risk or a fact (G12); `low` as in `has`."""
    it = lambda pattern: has(span, pattern, low=low)
    actual = it(ACTUAL)
    rules = [
        (it(PLAN), ("planned",)),
        (it(BEFORE), ("actual_historical",)),
        (it(GENERIC_RISK) & ~it(IMPACT) & ~it(EMBEDDED) & ~it(AT_TIMES), ("generic_risk",)),
        (it(MODAL), (F.when(actual, "actual_current_with_forecast").otherwise("hypothetical_risk"),)),
        (actual, ("actual_current",)),
    ]
    return first_of(rules, ("ambiguous",), ("s",))["s"]


def attribute_subject(df: DataFrame, span: str = "span", context: str = "context") -> DataFrame:
    """`df` with subject_type, relevance, scope, subject_reason, subject_entity, segment_name, factual_status."""
    both = F.concat_ws(" ", F.coalesce(F.col(context), F.lit("")), F.col(span))
    low, both_low = "_low", "_both_low"
    it = lambda pattern: has(span, pattern, low=low)
    impact = it(IMPACT)
    third = F.nullif(F.regexp_extract(span, THIRD_PARTY_PLAN, 1), F.lit(""))
    segment = F.when(may_have(low, SEGMENT), F.nullif(F.trim(F.regexp_extract(span, "(?i)" + SEGMENT, 1)), F.lit("")))
    customer = it(CUSTOMER_BENEFIT) | it(CUSTOMER)
    names = ("subject_type", "relevance", "scope", "subject_reason")
    own = ("target_company", "direct", "group_or_unspecified")
    ours = lambda ifso, ifnot: F.when(impact, row((*own, ifso), names)).otherwise(row(ifnot, names))
    rules = [
        (has(both, BIOGRAPHY, low=both_low), ("former_employer", "external", "external", "biography_or_career_history")),
        (it(QUOTE), ("third_party", "external", "external", "third_party_quote")),
        (customer, ours("customer_condition_with_explicit_company_impact", ("customer", "external", "external", "customer_is_grammatical_subject"))),
        (it(SUPPLIER), ours("supplier_cause_with_explicit_company_impact", ("supplier", "external", "external", "supplier_is_grammatical_subject"))),
        (it(COMPETITOR), ("competitor", "external", "external", "competitor_is_grammatical_subject")),
        (it(INDUSTRY), ("industry", "external", "sector", "industry_level_statement")),
        (third.isNotNull(), ("third_party", "external", "external", "named_third_party_is_subject")),
        (it(JOINT_VENTURE), ("joint_venture", "external_or_shared", "joint_venture", "joint_venture_subject")),
        (it(ACQUISITION_TARGET), ("acquisition_target", "external", "external", "acquisition_target_subject")),
        (it(SUBSIDIARY), ("target_subsidiary", "direct", "subsidiary", "controlled_subsidiary_reference")),
        (segment.isNotNull(), ("target_segment", "direct", "segment", "named_target_segment")),
        (has(span, ISSUER) | has(context, ISSUER), (*own, "issuer_reference")),
        (it(ACTUAL), ("target_company", "inferred", "group_or_unspecified", "factual_filing_clause_without_external_subject")),
    ]
    pick = first_of(rules, ("unknown", "unclear", "unknown", "subject_not_resolved"), names)
    of = lambda reason, value: F.when(F.col("subject_reason") == reason, value)
    lowered = df.withColumns({low: F.lower(span), both_low: F.lower(both)})
    out = lowered.withColumn("_s", pick).select(*df.columns, low, "_s.*")
    named = F.coalesce(of("named_third_party_is_subject", third), of("named_target_segment", segment))
    return out.withColumns({"subject_entity": named, "segment_name": of("named_target_segment", segment), "factual_status": factual_status(span, low)}).drop(low)


def acceptance(df: DataFrame, span: str = "span") -> DataFrame:
    """`df` with decision and decision_reason from subject, status and wording (G13); labour and supply events of suppliers are the suppliers'."""
    theirs = F.col("event_type").isin("labour_constraint", "supply_chain_constraint") & (has(span, SUPPLIER) | has(span, SUPPLIER_LABOUR))
    who = F.when(theirs, "supplier").otherwise(F.col("subject_type"))
    fact = F.col("factual_status")
    rules = [
        (has(span, TECHNICAL_REDUNDANCY), ("rejected", "technical_redundancy_not_workforce_event")),
        (has(span, PAGE_JOIN) & (F.length(span) > 280), ("rejected", "joined_page_table_fragment")),
        (has(span, ACCOUNTING_CONTEXT), ("rejected", "accounting_definition_or_cross_reference")),
        (has(span, EQUITY_METHOD), ("rejected", "external_equity_method_or_affiliate_context")),
        ((F.col("event_type") == "labour_constraint") & has(span, SUPPLIER_LABOUR) & ~has(span, IMPACT), ("rejected", "supplier_labour_condition_without_target_labour_event")),
        (who.isin(*EXTERNAL), ("rejected", F.concat(F.lit("external_subject:"), who))),
        (who == "unknown", ("ambiguous", "subject_unresolved")),
        (fact.isin("generic_risk", "hypothetical_risk"), ("rejected", fact)),
        (fact == "actual_historical", ("rejected", "historical_condition")),
    ]
    pick = first_of(rules, ("accepted", "acceptance_contract_satisfied"), ("decision", "decision_reason"))
    return df.withColumn("subject_type", who).withColumn("_d", pick).select(*df.columns, "_d.*")


def _verified(span: str) -> Column:
    subject = F.coalesce(F.col("subject_type"), F.lit("unknown"))
    risk = F.coalesce(F.col("factual_status").isin("generic_risk", "hypothetical_risk"), F.lit(False))
    rules = [
        (risk, ("reject", "HYPOTHETICAL_ONLY")),
        (subject == "unknown", ("reject", "WRONG_ENTITY")),
        (~subject.isin(*TARGETS), ("reject", "THIRD_PARTY_ONLY")),
        *((has(span, p, True), ("reject", code)) for code, p in EXCLUSIONS),
        ((F.length(span) < 25) | ~has(F.trim(F.col(span)), r"[.!?]$"), ("ambiguous", "SOURCE_FRAGMENT_AMBIGUOUS")),
        (subject == "target_segment", ("accept", "DIRECT_SEGMENT_EVENT")),
        (subject == "target_subsidiary", ("accept", "DIRECT_SUBSIDIARY_EVENT")),
        (F.col("event_status") == "planned", ("accept", "DIRECT_PLANNED_EVENT")),
    ]
    return first_of(rules, ("accept", "DIRECT_CURRENT_EVENT"), ("verdict", "code"))


def verify(df: DataFrame, span: str = "span") -> DataFrame:
    """`df` with verdict and code of the deterministic verifier."""
    return df.withColumn("_v", _verified(span)).select(*df.columns, "_v.*")


def sufficiency(span: str = "span") -> Column:
    """The six things that a candidate must have."""
    own = F.coalesce(F.col("subject_type").isin(*TARGETS), F.lit(False))
    terms = has(span, EVENT_TERMS)
    words = F.size(F.filter(F.split(span, r"\s+"), lambda w: w != ""))
    risk = F.coalesce(F.col("factual_status").isin("generic_risk", "hypothetical_risk"), F.lit(False))
    return F.struct(
        own.alias("subject"),
        (has(F.trim(F.col(span)), r"[.!?]$") & (words >= 5) & terms).alias("predicate"),
        ((~has(span, MIGHT) | has(span, DID)) & ~risk).alias("actuality"),
        (F.coalesce(F.col("event_status") != "", F.lit(False)) | has(span, TIMING)).alias("timing"),
        own.alias("target_relevance"),
        terms.alias("definition_fit"),
    )


def verify_sufficient(df: DataFrame, span: str = "span") -> DataFrame:
    """`df` with sufficiency, verdict and code (G15): exclusions, then what is missing (timing alone is ambiguous), then `verify`."""
    out = df.withColumn("sufficiency", sufficiency(span))
    parts = [F.col(f"sufficiency.{k}") for k in ("subject", "predicate", "actuality", "target_relevance", "definition_fit")]
    short = ~reduce(lambda a, b: a & b, parts)
    rules = [
        *((has(span, p, True), ("reject", code)) for code, p in GENERAL_EXCLUSIONS),
        (short, ("reject", "INSUFFICIENT_SUPPORT")),
        (~F.col("sufficiency.timing"), ("ambiguous", "TIMING_AMBIGUOUS")),
    ]
    deeper = _verified(span)
    pick = first_of(rules, (deeper["verdict"], deeper["code"]), ("verdict", "code"))
    return out.withColumn("_v", pick).select(*out.columns, "_v.*")


def combine(first: Column, second: Column) -> Column:
    """accept only if both do, reject if either does, else ambiguous."""
    return F.when((first == "accept") & (second == "accept"), "accept").when((first == "reject") | (second == "reject"), "reject").otherwise("ambiguous")


# The family of each event type.
FAMILIES = {
    "restructuring": "restructuring_cost_action",
    "cost_reduction": "restructuring_cost_action",
    "efficiency_programme": "restructuring_cost_action",
    "simplification": "restructuring_cost_action",
    "redundancy": "workforce",
    "workforce_reduction": "workforce",
    "labour_constraint": "workforce",
    "hiring": "workforce",
    "skills_investment": "workforce",
    "site_closure": "delivery_capacity_sites",
    "footprint_reduction": "delivery_capacity_sites",
    "capacity_reduction": "delivery_capacity_sites",
    "capacity_mismatch": "delivery_capacity_sites",
    "capacity_expansion": "delivery_capacity_sites",
    "new_facility": "delivery_capacity_sites",
    "operational_disruption": "delivery_capacity_sites",
    "growth_language": "demand_growth",
    "demand_growth": "demand_growth",
    "demand_weakness": "demand_growth",
    "customer_weakness": "demand_growth",
    "order_book_strength": "demand_growth",
    "recovery_language": "demand_growth",
    "supply_chain_constraint": "supply_chain_resilience",
    "inflation_pressure": "supply_chain_resilience",
    "destocking": "supply_chain_resilience",
    "supplier_diversification": "supply_chain_resilience",
    "procurement_intervention": "supply_chain_resilience",
    "inventory_buffer": "supply_chain_resilience",
    "supplier_insolvency": "supply_chain_resilience",
    "sourcing_concentration": "supply_chain_resilience",
    "logistics_disruption": "supply_chain_resilience",
    "quality_failure": "quality_regulatory",
    "recall": "quality_regulatory",
    "regulatory_intervention": "quality_regulatory",
    "safety_issue": "quality_regulatory",
    "compliance_breach": "quality_regulatory",
    "warranty_issue": "quality_regulatory",
    "remediation_programme": "quality_regulatory",
    "regulatory_investigation": "quality_regulatory",
    "transformation": "leadership_change_execution",
    "leadership_change": "leadership_change_execution",
}
# Wording that no family accepts, and that lifts such a refusal.
NEGATED = r"\b(?:no|not|without|did not|has not|have not|no plans? to)\b.{0,45}"
HYPOTHETICAL = r"\b(?:risk of|could|might|possibility of|if we|were we to|failure to|future .* depends?)\b"
HAPPENED = r"\b(?:announced|implemented|experienced|affected|impacted|occurred|continued)\b"
LONG_AGO = r"\b(?:in the past|at various times in the past|historically)\b"
STILL = r"\b(?:currently|ongoing|continues?|this (?:year|quarter|period)|now)\b"
FORMER = r"\b(?:formerly|in 20\d\d|last year|previously)\b"
ENDED = r"\b(?:complete|completed|concluded|ended|former|previous)\b"
# Refusals of single families: (pattern, wording that lifts it, reason).
REFUSALS = {
    "demand_growth": [
        (r"\b(?:cost|costs|expense|expenses)\b.{0,45}\b(?:increased|grew|growth)\b", None, "expense_growth_is_not_demand_growth"),
        (r"\b(?:increased|grew)\b.{0,45}\b(?:cost|costs|expense|expenses)\b", None, "expense_growth_is_not_demand_growth"),
        (r"\b(?:strategy|aim|goal|need to|seek to|future success)\b", r"\b(?:revenue|sales|orders?|backlog|demand|volume)\b.{0,50}\b(?:increased|grew|declined|decreased)\b", "aspiration_not_observed_change"),
        (r"\bbacklog\b.{0,80}\b(?:key .*measure|forward-looking|focus on)\b", None, "metric_description_not_observed_change"),
    ],
    "restructuring_cost_action": [
        (r"\b(?:costs?|expenses?)\b.{0,45}\b(?:increased|rose|grew)\b", r"\b(?:reduce|reduction|saving|restructur|efficien|simplif)\w*\b", "cost_increase_is_not_cost_action"),
        (r"cost reduction initiative", r"\b(?:implemented|initiated|announced|pursue|launched|undertook|executing)\b", "programme_or_product_name_only"),
        (r"\b(?:our )?(?:customer|customers|supplier|suppliers|competitor|competitors)\b.{0,100}\b(?:entered|announced|implemented|initiated|restructur|cost reduc|efficien)", None, "third_party_action"),
        (r"\b(?:from time to time|may|could|risk of)\b", r"\b(?:announced|implemented|initiated|incurred|recognized|recognised|approved|committed)\b", "generic_or_hypothetical_action"),
    ],
    "leadership_change_execution": [(r"\b(?:biography|previous employer|prior to joining|formerly served)\b", None, "biography_or_prior_employer")],
}
# The reasons of each family for accepting and for leaving open.
REASONS = {
    "demand_growth": ("direct_demand_change", "demand_change_not_entailed"),
    "restructuring_cost_action": ("direct_or_indirect_target_action", "action_identity_not_entailed"),
    "workforce": ("direct_workforce_event", "workforce_event_not_entailed"),
    "delivery_capacity_sites": ("direct_capacity_or_delivery_event", "capacity_or_delivery_event_not_entailed"),
    "supply_chain_resilience": ("direct_supply_condition", "supply_condition_not_entailed"),
    "quality_regulatory": ("direct_quality_or_regulatory_event", "quality_or_regulatory_event_not_entailed"),
    "leadership_change_execution": ("direct_change_execution_event", "change_execution_event_not_entailed"),
}
# Wording that supports an event of a type; under the family's name, for its other types.
SUPPORT = {
    "demand_growth": r"\b(?:revenue|sales|orders?|backlog|demand|unit sales|volume)\b.{0,100}\b(?:increased|grew|growth|declined|decreased|fell|weakness|softened|strong|record)\b|\b(?:increased|grew|declined|decreased|fell)\b.{0,100}\b(?:revenue|sales|orders?|backlog|demand|volume)\b",
    "redundancy": r"\b(?:announced|began|completed|plans? to|will|consultation|reduced|reducing|eliminated)\b.{0,100}\b(?:redundan|workforce|headcount|positions?|roles?)\b|\b(?:redundan|workforce reductions?|headcount reduction)\b.{0,80}\b(?:announced|began|completed|planned|initiated|ongoing)\b",
    "hiring": r"\b(?:we|company|group|segment)\b.{0,80}\b(?:hiring|recruiting|recruited|training|skills investment)\b|\b(?:hiring|recruiting|recruited)\b.{0,80}\b(?:employees|engineers|staff|roles?)\b",
    "workforce": r"\b(?:labou?r shortage|staff shortage|strike|employee turnover|workforce availability)\b.{0,100}\b(?:affected|impacted|constrained|disrupted|operations?|production)?",
    "site_closure": r"\b(?:closed|closing|will close|permanently shut|permanent shutdown|announced.{0,30}closure)\b.{0,70}\b(?:sites?|plants?|factor(?:y|ies)|facilit(?:y|ies))\b|\b(?:site|plant|factory|facility) closures?\b.{0,70}\b(?:resulting|implemented|announced|related actions?)\b|\bsite closure\b.{0,50}\b(?:announced|implemented|completed)\b",
    "footprint_reduction": r"\b(?:reduc|consolidat)\w*.{0,45}\b(?:footprint|sites|facilities|locations)\b",
    "capacity_reduction": r"\b(?:reduc|cut|removed)\w*.{0,45}\bcapacity\b|\bcapacity reduction\b",
    "capacity_mismatch": r"\b(?:excess|underutili[sz]ed|unused)\b.{0,35}\bcapacity\b",
    "capacity_expansion": r"\b(?:expanded|expanding|added|adding|will add|will increase|increased|commissioned)\w*.{0,70}\b(?:capacity|warehouse|facility|plant|production line|new line)\b|\b(?:capacity expansion|new production line)\b.{0,60}\b(?:announced|opened|commissioned|planned)\b",
    "new_facility": r"\b(?:opened|opening|built|building|constructing|commissioned)\b.{0,70}\b(?:new )?(?:facility|site|plant|factory|warehouse|distribution centre|distribution center)\b",
    "operational_disruption": r"\b(?:production|operations?|delivery|site|plant)\b.{0,60}\b(?:paused|halted|disrupted|interrupted|suspended|temporarily shut|temporary shutdown)\b|\b(?:operational disruption|temporary shutdown)\b.{0,60}\b(?:occurred|began|continued|during)\b",
    "supplier_diversification": r"\b(?:we|group|company)\b.{0,80}\b(?:added|approved|qualified|diversified)\b.{0,60}\b(?:supplier|source|sourcing)\b",
    "procurement_intervention": r"\b(?:we|group|company)\b.{0,80}\b(?:launched|implemented|centralised|centralized)\b.{0,60}\bprocurement\b",
    "inventory_buffer": r"\b(?:we|group|company)\b.{0,80}\b(?:built|increased|established)\b.{0,60}\b(?:inventory|safety stock|buffer stock)\b",
    "supplier_insolvency": r"\b(?:supplier|vendor)\b.{0,60}\b(?:insolven|bankrupt|administration)\w*\b.{0,100}\b(?:affected|delayed|disrupted|our)\b",
    "sourcing_concentration": r"\b(?:we|group|company)\b.{0,80}\b(?:depends? on (?:a |one )?supplier|single.source|sole supplier|concentrated sourcing)\b",
    "logistics_disruption": r"\b(?:our|company|group)\b.{0,80}\b(?:shipments?|deliveries|logistics)\b.{0,70}\b(?:delayed|disrupted|interrupted)\b",
    "supply_chain_resilience": r"\b(?:we|our|company|group|operations?|production|deliveries)\b.{0,100}\b(?:experienced|affected|impacted|constrained|disrupted|shortage|destocking|cost inflation)\b|\b(?:supply chain disruption|component shortages?|material shortages?|commodity shortages?|destocking|cost inflation)\b.{0,100}\b(?:affected|impacted|reduced|delayed|continued|during)\b",
    "recall": r"\b(?:we|company|group)\b.{0,80}\b(?:recalled|initiated a recall|issued a recall)\b|\bproduct recall\b.{0,60}\b(?:initiated|announced|during)\b",
    "regulatory_intervention": r"\b(?:regulator|authority|agency)\b.{0,90}\b(?:ordered|restricted|suspended|fined|enforcement)\b",
    "regulatory_investigation": r"\b(?:regulator|authority|agency)\b.{0,90}\b(?:opened|launched|commenced|is conducting)\b.{0,60}\binvestigation\b",
    "safety_issue": r"\b(?:safety incident|safety issue|injury)\b.{0,90}\b(?:occurred|resulted|caused|required)\b",
    "compliance_breach": r"\b(?:breached|violated|non-compliance|noncompliance)\b.{0,90}\b(?:requirement|regulation|permit|standard)\b",
    "warranty_issue": r"\b(?:warranty claims?|warranty costs?)\b.{0,90}\b(?:increased|rose|required|resulted)\b",
    "remediation_programme": r"\b(?:launched|implemented|initiated|began)\b.{0,80}\b(?:remediation|corrective action)\b",
    "quality_regulatory": r"\b(?:defect|quality failure|nonconformance|quality issue)\w*\b.{0,90}\b(?:affected|caused|resulted|required|during)\b",
    "leadership_change": r"\b(?:appointed|named|resigned|stepped down|departed|will join|succeeded)\b.{0,75}\b(?:chief|ceo|cfo|coo|president|director|officer|chair)\b|\b(?:chief|ceo|cfo|coo|president|director|officer|chair)\b.{0,75}\b(?:appointed|resigned|stepped down|departed)\b",
    "leadership_change_execution": r"\b(?:launched|initiated|implemented|executing|underway|ongoing)\b.{0,100}\b(?:transformation|change programme|change program)\b|\b(?:transformation|change programme|change program)\b.{0,100}\b(?:launched|initiated|implemented|underway|ongoing|continue|deployed)\b|\b(?:continue on|continuing|multi-year)\b.{0,100}\b(?:transformation|change) initiative\b",
}
# Types that share another type's wording.
SAME_SUPPORT = {"workforce_reduction": "redundancy", "skills_investment": "hiring"}
# Wording of cost actions and of supply constraints that continue.
IDENTITY = r"\b(?:restructur|cost[- ]reduc|cost-saving|efficien|simplif|footprint optimi[sz]|operating.model redesign|structural cost|consolidat|organi[sz]ational redesign|workforce reshap|productivity initiative|productivity programme|productivity program)\w*\b"
ACTION = r"\b(?:announced|implemented|initiated|pursue|pursuing|incurred|recognized|recognised|ongoing|launched|undertook|executing|approved|committed|completed|began|closed|actions? to|programme is|program is|are redesigning|is redesigning|implements?|implementing|continues? on)\b"
INDIRECT = r"\b(?:eliminat(?:e|ed|ing) positions|consolidat(?:e|ed|ing) (?:sites|operations)|reduce(?:d|ing)? (?:headcount|the cost base)|workforce reductions?)\b"
ACCRUAL = r"\b(?:our |the )?restructuring (?:accrual|liability|plan)\b"
ACCRUAL_USE = r"\b(?:at|as of|expected to (?:be paid|impact)|fiscal 20\d\d plan|charges?|cash payments?)\b"
PROVISION = r"\b(?:provision|accounting policy|definition|defined as)\b"
CONTINUING = r"\bthese included ongoing supply chain disruptions?\b|\b(?:ongoing |global )?supply chain disruptions?\b.{0,120}\b(?:included|have impacted|has impacted|impacted|continue|mitigated|procure|delays?|increased costs?)\b|\b(?:implemented actions|implemented certain actions)\b.{0,100}\bsupply chain disruptions?\b.{0,50}\bcontinue\b"


def route(event_type: Column) -> Column:
    """The family of an event type, null for others."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), event_type)


def _supported(span: str, event: Column, family: Column) -> Column:
    """Whether the wording of the type, or of the family for types without their own, is there."""
    own = {**SUPPORT, **{t: SUPPORT[k] for t, k in SAME_SUPPORT.items()}}
    plain = F.lit(False)
    families = list(dict.fromkeys(FAMILIES.values()))
    for name in families:
        if name in own:
            plain = F.when(family == name, has(span, own[name])).otherwise(plain)
    for name, pattern in own.items():
        if name not in families or name == "demand_growth":
            plain = F.when(event == name, has(span, pattern)).otherwise(plain)
    action = (has(span, IDENTITY) & has(span, ACTION)) | has(span, INDIRECT) | (has(span, ACCRUAL) & has(span, ACCRUAL_USE))
    return F.when(family == "restructuring_cost_action", action).when(family == "supply_chain_resilience", plain | has(span, CONTINUING)).otherwise(plain)


def verify_family(df: DataFrame, span: str = "span") -> DataFrame:
    """`df` with family, disposition and reason of the family's verifier (G16); types of no family are left open."""
    family, event = F.col("family"), F.col("event_type")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)
    own = F.coalesce(F.col("subject_type").isin(*TARGETS), F.lit(False))
    accrual = has(span, ACCRUAL) & has(span, ACCRUAL_USE)
    rules = [
        (family.isNull(), ("ambiguous", "family_not_implemented")),
        (F.trim(F.col(span)) == "", ("reject", "missing_exact_provenance")),
        (flag("heading_only"), ("reject", "heading_only")),
        (flag("accounting_table_only"), ("reject", "accounting_table_only")),
        (~own, ("reject", "wrong_entity")),
        (has(span, NEGATED), ("reject", "negated_event")),
        (has(span, HYPOTHETICAL) & ~has(span, HAPPENED), ("reject", "hypothetical_only")),
        (has(span, LONG_AGO) & ~has(span, STILL), ("reject", "historical_only")),
        (has(span, FORMER) & has(span, ENDED), ("reject", "historical_only")),
    ]
    for name, refusals in REFUSALS.items():
        for pattern, unless, reason in refusals:
            test = (family == name) & has(span, pattern)
            rules.append((test if unless is None else test & ~has(span, unless), ("reject", reason)))
    rules.append(((family == "restructuring_cost_action") & has(span, PROVISION) & ~has(span, ACTION) & ~accrual, ("ambiguous", "accounting_reference_without_action")))
    good, open_ = (F.create_map(*(F.lit(x) for k, v in REASONS.items() for x in (k, v[i]))) for i in (0, 1))
    rules.append((_supported(span, event, family), ("accept", F.try_element_at(good, family))))
    out = df.withColumn("family", F.coalesce(route(event), F.lit(None).cast("string")))
    pick = first_of(rules, ("ambiguous", F.try_element_at(open_, family)), ("disposition", "reason"))
    return out.withColumn("_d", pick).withColumn("family", F.coalesce("family", F.lit("unrouted"))).select(*out.columns, "_d.*")


# Wording of the categories of an ambiguous candidate, and of failure classes.
CATEGORIES = [
    ("historical_vs_current", r"\bfiscal 20\d\d\b"),
    ("hypothetical_vs_actual", r"\b(?:may|might|could|risk of|possibility)\b"),
    ("planned_vs_realised", r"\b(?:plan|planned|will|expect|committed|initiated|completed|ongoing)\b"),
    ("issuer_vs_third_party", r"\b(?:customer|supplier|competitor|industry|market participants?)\b"),
    ("executive_appointments", r"\b(?:appointed|named|resigned|stepped down|chief executive|chief financial)\b"),
]
CATEGORY_NAMES = {"supply_chain_resilience": "supply_chain", "delivery_capacity_sites": "capacity_sites", "leadership_change_execution": "change_leadership"}


def ambiguity_categories(df: DataFrame, span: str = "span", context: str = "context") -> DataFrame:
    """`df` (family, timing, polarity) with categories: all that make a candidate hard to label, sorted."""
    text = F.concat_ws(" ", span, context)
    known = {"historical_vs_current": F.col("timing").isin("historical", "current", "ongoing"), "hypothetical_vs_actual": F.col("timing") == "hypothetical"}
    tests = [(name, has(text, p) | F.coalesce(known.get(name, F.lit(False)), F.lit(False))) for name, p in CATEGORIES]
    tests.append(("polarity_ambiguity", F.coalesce(F.col("polarity").isin("positive", "negative", "neutral", "unclear"), F.lit(False))))
    names = F.create_map(*(F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv))
    every = [F.lit("event_identity_ambiguity"), *(F.when(c, F.lit(k)) for k, c in tests), F.coalesce(F.try_element_at(names, F.col("family")), F.col("family"))]
    return df.withColumn("categories", F.array_sort(F.array_distinct(F.array_compact(F.array(*every)))))


def failure_class(df: DataFrame, span: str = "span") -> DataFrame:
    """`df` (classification, event_type) with failure_class, expected, expected_status."""
    kind = F.col("classification")
    plain = lambda *words: reduce(lambda a, b: a | b, (F.contains(F.lower(span), F.lit(w)) for w in words))
    rules = [
        (kind == "DUPLICATE_EVENT", ("duplicate",)),
        (plain("served as", "career", "where she worked"), ("biography",)),
        (plain("redundancy and other continuity", "as a simplification"), ("taxonomy_overreach",)),
        (plain("may include", "assumptions about"), ("generic_boilerplate",)),
        (plain(" may ", " could ", " if ", "risk of"), ("hypothetical_risk",)),
        (kind == "AMBIGUOUS", ("incomplete_source",)),
        (kind == "MISSED_EVENT", ("synonym_or_phrase_structure_missing",)),
        (kind == "FALSE_POSITIVE", ("contextual_false_positive",)),
    ]
    expected = first_of(
        [
            ((kind == "MISSED_EVENT") & (F.col("event_type") == "major_investment"), ("accepted", "planned")),
            (kind == "MISSED_EVENT", ("accepted", "current_or_ongoing")),
            (kind.isin("FALSE_POSITIVE", "DUPLICATE_EVENT"), ("rejected", "hypothetical_or_irrelevant")),
        ],
        ("ambiguous", "requires_human_adjudication"),
        ("expected", "expected_status"),
    )
    name = first_of(rules, ("unadjudicated_plausible_ai_omission",), ("failure_class",))["failure_class"]
    return df.withColumn("failure_class", name).withColumn("_e", expected).select(*df.columns, "failure_class", "_e.*")
