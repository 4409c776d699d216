"""Document to event and observation jobs as staged pipelines: each stage adds columns, no row is lost."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from tidemark.functions.text import collapse, unescape
from tidemark.operators import joins as jo
from tidemark.sources.scratch import saved

# Event types of contextual extraction, their patterns and groups.
EVENTS = {
    "cost_reduction": (r"cost(?: |-)(?:reduction|saving)", "intervention"),
    "restructuring": (r"restructur(?:e|ed|ing)", "intervention"),
    "efficiency_programme": (r"efficiency (?:programme|program|initiative)", "intervention"),
    "simplification": (r"simplif(?:y|ication)", "intervention"),
    "transformation": (r"transformation (?:programme|program|initiative)", "intervention"),
    "demand_weakness": (r"(?:weak|weaker|declining|lower|soft) demand", "operational_pressure"),
    "supply_chain_constraint": (r"supply.chain (?:constraint|disruption|shortage|pressure)", "operational_pressure"),
    "labour_constraint": (r"labou?r (?:constraint|shortage|scarcity)", "operational_pressure"),
    "capacity_reduction": (r"(?:capacity reduction|reduce(?:d|ing) capacity)", "intervention"),
    "site_closure": (r"(?:site|plant|facility) closure|clos(?:e|ed|ing) (?:a |the )?(?:site|plant|facility)", "intervention"),
    "redundancy": (r"redundan(?:cy|cies|t)", "intervention"),
    "refinancing": (r"refinanc(?:e|ed|ing)", "financial_pressure"),
    "liquidity_concern": (r"liquidity (?:concern|constraint|pressure)", "financial_pressure"),
    "growth_language": (r"(?:revenue|sales|volume) growth|strong growth", "contrary_strength"),
    "order_book_strength": (r"(?:strong|record|growing) order.book", "contrary_strength"),
    "capacity_expansion": (r"capacity expansion|expand(?:ed|ing) capacity", "expansion"),
    "major_investment": (r"major investment|investment programme|investment program", "expansion"),
    "new_facility": (r"new (?:facility|plant|factory|site)", "expansion"),
}
# Wording that decides a candidate's status.
NEGATION = r"(?i)\b(?:no|not|without|neither|nor)\b"
HISTORICAL = r"(?i)\b(?:completed|previously announced|announced in 20\d\d|last year|prior year|following the)\b"
HYPOTHETICAL = r"(?i)\b(?:may|might|could|potentially|risk of|possibility|if|should)\b"
PLANNED = r"(?i)\b(?:plan(?:ned|s)? to|expect(?:ed)? to|intend(?:ed)? to|will )"
ACTUAL = r"(?i)\b(?:currently|ongoing|announced|declined|decreased|increased|recovered|paused|slowed|has reduced|have reduced|is experiencing)\b"
BIOGRAPHY = r"(?i)\b(?:served as|began (?:his|her|their) career|career at|previous employers?)\b"
ACCOUNTING = r"(?i)\b(?:may include|these items consist of|for purposes of this definition|troubled debt restructur)"
OWN = r"(?i)\b(?:we|our|us|the company|the group)\b"
THIRD = r"(?i)\b(?:competitors?|customers?|suppliers?|vendors?|third part(?:y|ies))\b"
OPERATIONAL = r"(?i)\b(?:sales|revenue|volume|backlog|demand|margin|cost|restructur|severance|workforce|employee|appoint|facility|plant|site|capacity|production|supply|supplier|inventory|recall|quality|regulator|closure|opened|disruption|investment|charges?)\b"
CHANGE = r"(?i)(?:\$|£|€|\b\d+(?:\.\d+)?%|\b(?:increased|decreased|grew|declined|reduced)\b)"


def visible_text(html: Column) -> Column:
    """The text outside of scripts, styles, comments, hidden blocks and tags, collapsed; references stay (G1)."""
    out = html
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?is)<[^>]*\bhidden\b[^>]*>.*?</[^>]*>", r"<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return collapse(out)


def visible_plain_text(html: Column) -> Column:
    """`visible_text` with character references decoded."""
    return collapse(unescape(visible_text(html)))


def sentences(text: Column, least: int = 20, most: int = 1000, bars: bool = False) -> Column:
    """Sentences of least to most characters, split after . ! ? (or at bars)."""
    parts = F.split(text, r"(?<=[.!?])\s+" + (r"|\s+\|\s+" if bars else ""))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: F.length(s).between(least, most))


def with_context(df: DataFrame, text: str, keys: Sequence[str], **limits) -> DataFrame:
    """keys, position, sentence, context: each sentence with its neighbours (G3), cut from the array before it is exploded."""
    s = df.select(*keys, sentences(F.col(text), **limits).alias("_s"))
    near = lambda x, i: F.struct(x.alias("sentence"), F.array_join(F.slice("_s", F.greatest(i, F.lit(1)), F.least(F.lit(3), F.least(i + 2, F.lit(3)))), " ").alias("context"))
    return s.select(*keys, F.posexplode(F.transform("_s", near)).alias("position", "p")).select(*keys, "position", "p.*")


def matches(text: Column, rules: dict[str, str]) -> Column:
    """The rules that the text matches, as one array, so that only hits become rows."""
    return F.array_compact(F.array(*(F.when(text.rlike("(?i)" + p), F.lit(k)) for k, p in rules.items())))


def scan(df: DataFrame, text: str, keys: Sequence[str], rules: dict[str, str], **limits) -> DataFrame:
    """keys, position, rule, sentence, quantified: a row per sentence and rule."""
    s = df.select(*keys, F.posexplode(sentences(F.col(text), **limits)).alias("position", "sentence"))
    return s.select(*keys, "position", F.explode(matches(F.col("sentence"), rules)).alias("rule"), "sentence", F.col("sentence").rlike(r"\d").alias("quantified"))


def contextual_events(df: DataFrame, text: str, keys: Sequence[str], rules: dict[str, str] | None = None, **limits) -> DataFrame:
    """keys, position, event_type, sentence, status, quantified.

    A match is negated if a negation stands in the 100 characters before it, historical if the sentence
    has such words, else current. One row for each type and sentence of a document; a sentence with a
    current match is current.
    """
    rules = rules or {k: p for k, (p, _) in EVENTS.items()}
    s = df.select(*keys, F.posexplode(sentences(F.col(text), **limits)).alias("position", "sentence"))
    hit = s.select(*keys, "position", "sentence", F.explode(matches(F.col("sentence"), rules)).alias("event_type"))
    pattern = F.lit(None).cast("string")
    for k, p in rules.items():
        pattern = F.when(F.col("event_type") == k, F.lit("(?i)" + p)).otherwise(pattern)
    at = F.regexp_instr("sentence", pattern)
    before = F.substring(F.col("sentence"), F.greatest(F.lit(1), at - 100), F.least(at - 1, F.lit(100)))
    status = F.when(before.rlike(NEGATION), "negated").when(F.col("sentence").rlike(HISTORICAL), "historical_or_completed").otherwise("current_or_general")
    rows = hit.withColumn("status", status).withColumn("quantified", F.col("sentence").rlike(r"\d"))
    key = F.lower(collapse(F.col("sentence")))
    return rows.groupBy(*keys, "event_type", key.alias("_k")).agg(F.min("position").alias("position"), F.min_by("sentence", "position").alias("sentence"), F.min(F.when(F.col("status") == "current_or_general", "a").when(F.col("status") == "historical_or_completed", "b").otherwise("c")).alias("_s"), F.bool_or("quantified").alias("quantified")).select(*keys, "event_type", "position", "sentence", F.when(F.col("_s") == "a", "current_or_general").when(F.col("_s") == "b", "historical_or_completed").otherwise("negated").alias("status"), "quantified")


def _term(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("event_type"), m.alias("term"))


def candidates(df: DataFrame, text: str, keys: Sequence[str], rules: dict[str, str], **limits) -> DataFrame:
    """keys, position, event_type, term, sentence, context: every match of every rule."""
    s = with_context(df, text, keys, **limits)
    hits = F.flatten(F.array(*(F.transform(F.regexp_extract_all("sentence", F.lit(f"(?i)({p})"), F.lit(1)), _term(k)) for k, p in rules.items())))
    return s.select(*keys, "position", "sentence", "context", F.explode(hits).alias("h")).select(*keys, "position", "h.*", "sentence", "context")


def assess(df: DataFrame) -> DataFrame:
    """`df` (sentence, context) with entity, decision, status, reason: an ordered ladder, first match decides."""
    s, c = F.col("sentence"), F.col("context")
    actual, planned = s.rlike(ACTUAL), s.rlike(PLANNED)
    entity = F.when(c.rlike(OWN), "target_company").when(s.rlike(THIRD), "third_party").otherwise("unclear")
    ladder = [
        (c.rlike(BIOGRAPHY), "rejected", "background", "biography"),
        (s.rlike(ACCOUNTING), "rejected", "background", "accounting_or_definition"),
        (s.rlike(NEGATION), "rejected", "negated", "explicit_negation"),
        (s.rlike(HISTORICAL) & ~planned, "rejected", "historical", "historical_or_completed"),
        (s.rlike(HYPOTHETICAL) & ~actual, "rejected", "hypothetical", "generic_or_hypothetical_risk"),
        (entity == "third_party", "rejected", "third_party", "wrong_entity"),
        ((entity == "unclear") & ~actual & ~planned, "ambiguous", "ambiguous", "entity_or_factuality_unclear"),
    ]
    pick = F.struct(F.lit("accepted").alias("decision"), F.when(planned, "planned").when(F.lower(s).contains("ongoing"), "ongoing").otherwise("current").alias("status"), F.lit(None).cast("string").alias("reason"))
    for test, decision, status, reason in reversed(ladder):
        pick = F.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(pick)
    return df.withColumn("entity", entity).withColumn("_p", pick).select(*df.columns, "entity", "_p.decision", "_p.status", "_p.reason")


def _grams(texts: DataFrame, keys: Sequence[str], q: int) -> DataFrame:
    """keys, id, size, n, token: each text's q-grams, the kth of equal ones as a token of its own."""
    many = F.col("size") - q + 1
    each = texts.where(many > 0).select(*keys, "id", "size", many.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), many), lambda i: F.substring("t", i, q))).alias("g"))
    times = F.row_number().over(Window.partitionBy(*keys, "id", "g").orderBy("g"))
    return each.select(*keys, "id", "size", "n", F.concat("g", F.lit("#"), times.cast("string")).alias("token"))


def likely_pairs(texts: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """keys, left_id, right_id: the pairs of `texts` (keys, id, t, size) that can have a ratio of `least`, the smaller id first.

    A ratio of matching blocks r over both texts' L characters has r L / 2 matched ones, in no more blocks than
    unmatched ones and one; each block of m has m - q + 1 q-grams. So such a pair shares many q-grams, and meets by one
    of the rarest of each text. Texts too short for that meet by single characters.
    """
    q = 3 if least >= 0.85 else 2 if least >= 0.75 else 1
    slope = lambda q: least / 2 - (1 - least) * (q - 1)
    need = lambda total, q: F.greatest(F.ceil(total * slope(q) - (q - 1) - 1e-9), F.lit(1))
    shorter = least / (2 - least)
    short = int((q - 1) / slope(q)) + 1
    found = None
    for size in {q, 1}:
        some = texts if size == q else texts.where(F.col("size") <= short)
        prefix = jo.rarest(saved(_grams(some, keys, size)), keys, need(F.col("size") + F.ceil(F.col("size") * shorter - 1e-9), size))
        left, right = jo.sides(prefix, "true", "true", keys, ["size"])
        fits = (F.col("left_id") < F.col("right_id")) & (F.least("left_size", "right_size") >= F.greatest("left_size", "right_size") * shorter - 1e-9)
        shared = need(F.col("ln") + F.col("rn") + 2 * (size - 1), size)
        met = jo.meet(left, right, [*keys, "token"], fits, shared)
        pairs = jo.likely(met, keys, shared).select(*keys, "left_id", "right_id")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def alike(left: Sequence[str], right: Sequence[str], least: float) -> list[bool]:
    """Whether the ratio of matching blocks of each pair is `least` or more.

    Characters that two texts have in common bound their matching blocks, so most pairs are told by these. The
    matcher keeps what it knows of its second text, so pairs are told by their right text.
    """
    out, bags = [False] * len(left), {}
    matcher, known = difflib.SequenceMatcher(None), None
    for k in sorted(range(len(left)), key=right.__getitem__):
        a, b = left[k], right[k]
        x, y = (bags[t] if t in bags else bags.setdefault(t, Counter(t)) for t in (a, b))
        total = len(a) + len(b)
        common = sum(min(n, y[c]) for c, n in x.items() if c in y)
        if total and 2.0 * common / total < least:
            continue
        if b != known:
            matcher.set_seq2(b)
            known = b
        matcher.set_seq1(a)
        out[k] = matcher.ratio() >= least
    return out


def _alike(least: float):
    return pandas_udf(lambda left, right: pd.Series(alike(left.to_list(), right.to_list(), least), dtype=bool), BooleanType())


#: Pairs are dealt over so many parts where they meet the states, as a text may have many pairs.
PARTS = 16


def first_come(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, id, kept: whether each id of `pairs` (left_id < right_id) is kept, if in order each is kept that meets no kept one before it.

    Each round decides all whose earlier neighbours allow it: out by a kept one, kept if all are out. The
    smallest open one is decided in every round, and most are in the first few.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    edges = saved(pairs.withColumn("_part", F.pmod(F.xxhash64("right_id"), F.lit(PARTS)).cast("int")))
    later = edges.select(*keys, F.col("right_id").alias("id")).distinct()
    state = edges.select(*keys, F.col("left_id").alias("id")).distinct().join(later, [*keys, "id"], "left_anti").withColumn("kept", F.lit(True)).unionByName(later.withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        state = saved(state)
        if state.where("kept is null").isEmpty():
            return state
        known = state.select(*keys, F.col("id").alias("left_id"), "kept").withColumn("_part", parts)
        told = edges.join(known, [*keys, "left_id", "_part"]).groupBy(*keys, F.col("right_id").alias("id")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("_out"), F.bool_or(F.col("kept").isNull()).alias("_open"))
        state = state.join(told, [*keys, "id"], "left").select(*keys, "id", F.coalesce("kept", F.when(F.col("_out"), False).when(~F.col("_open"), True)).alias("kept"))


def near_duplicate_events(df: DataFrame, keys: Sequence[str], order: str, text: str, least: float = 0.86) -> DataFrame:
    """keys, order, canonical: rows that repeat an earlier kept row of their group.

    Greedy in order: a row is kept unless its text has a ratio of `least` or more with a kept one, and
    belongs to the first such. Equal texts are folded before; `order` is unique in a group. Pairs that
    can have the ratio meet by their rarest q-grams and are dealt over all partitions, as each takes time, and
    the choice is made in rounds, so that no task holds a group. Rows with a null key, order or text are left out.
    """
    plain = F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))
    rows = saved(df.select(*keys, order, plain.alias("_t")).dropna())
    first = saved(rows.groupBy(*keys, "_t").agg(F.min(order).alias("_first")))
    same = rows.join(first, [*keys, "_t"]).where(F.col(order) != F.col("_first")).select(*keys, order, F.col("_first").alias("canonical"))
    texts = first.select(*keys, F.col("_first").alias("id"), F.col("_t").alias("t"), F.length("_t").alias("size"))
    side = lambda name: texts.select(*keys, F.col("id").alias(f"{name}_id"), F.col("t").alias(f"{name}_t"))
    likely = likely_pairs(texts, keys, least).join(side("left"), [*keys, "left_id"]).join(side("right"), [*keys, "right_id"])
    dealt = likely.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "right_id", F.pmod(F.xxhash64("left_id"), F.lit(PARTS)))
    pairs = saved(dealt.where(_alike(least)("left_t", "right_t")).select(*keys, "left_id", "right_id"))
    kept = first_come(pairs, keys).where("kept").select(*keys, F.col("id").alias("left_id"))
    folded = pairs.join(kept, [*keys, "left_id"]).groupBy(*keys, F.col("right_id").alias(order)).agg(F.min("left_id").alias("canonical"))
    onward = folded.select(*keys, F.col(order).alias("_at"), F.col("canonical").alias("_onward"))
    joined = same.join(onward.withColumnRenamed("_at", "canonical"), [*keys, "canonical"], "left")
    return joined.select(*keys, order, F.coalesce("_onward", "canonical").alias("canonical")).unionByName(folded)


def zones(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """keys, position, start, stop, zone, reasons: paragraphs with operational wording or quantified change.

    start and stop are zero-based character offsets of the line, summed over the lines before it.
    """
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_n", "_line"))
    before = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("_line") + 1).over(before), F.lit(0)).cast("int")).withColumn("position", F.coalesce(F.count(F.when(F.col("_line") != "", 1)).over(before), F.lit(0)).cast("int"))
    rows = placed.where("_line <> ''").select(*keys, "position", "start", F.trim("_line").alias("zone"))
    reasons = F.array_compact(F.array(F.when(F.col("zone").rlike(OPERATIONAL), F.lit("operational_language")), F.when(F.col("zone").rlike(CHANGE), F.lit("quantitative_or_directional_change"))))
    return rows.withColumn("reasons", reasons).where((F.col("zone") != "") & (F.size("reasons") > 0)).withColumn("stop", F.col("start") + F.length("zone"))


def validate_facts(df: DataFrame) -> DataFrame:
    """Facts (zone, zone_start, span, subject, action, object, entity) with verdict, absolute offsets and id."""
    at = F.expr("instr(zone, span)")
    whole = F.col("subject").isNotNull() & F.col("action").isNotNull() & F.col("object").isNotNull()
    out = df.withColumn("_at", at)
    verdict = F.when(F.col("_at") == 0, "reject").when(~whole, "reject").when(F.coalesce(F.col("entity"), F.lit("unclear")) == "unclear", "ambiguous").otherwise("accept")
    start = F.when(F.col("_at") > 0, F.col("zone_start") + F.col("_at") - 1)
    return out.withColumn("verdict", verdict).withColumn("start", start).withColumn("stop", start + F.length("span")).withColumn("fact_id", F.concat(F.lit("fact-"), F.substring(F.sha2(F.concat_ws("|", "zone", "span"), 256), 1, 16))).drop("_at")


def labelled_figures(df: DataFrame, text: str, keys: Sequence[str], aliases: dict[str, str]) -> DataFrame:
    """keys, page, metric, value, unit: `label: value` lines with a known label; pages by the marks before them."""
    from tidemark.functions.parse import amount

    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("_n", "_line"))
    mark = F.regexp_extract("_line", r"(?i)^\s*\[?page (\d+)\]?\s*$", 1).try_cast("int")
    before = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select(*keys, F.struct(F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(1)).alias("page"), F.col("_line").alias("line")).alias("z"))
    label = F.lower(F.trim(F.regexp_extract("z.line", r"^([^:]{2,60}):\s*(.+)$", 1)))
    metric = F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), label)
    parsed = amount(F.regexp_extract("z.line", r"^([^:]{2,60}):\s*(.+)$", 2))
    return rows.select(*keys, F.col("z.page").alias("page"), metric.alias("metric"), parsed.alias("a")).where("metric is not null and a.value is not null").select(*keys, "page", "metric", "a.*")


def canonical_value(metric: Column, value: Column) -> Column:
    """Capital expenditure is told without its sign."""
    return F.when(metric == "capex", F.abs(value)).otherwise(value)


def difficulty(df: DataFrame, probes: dict[str, Column], least: int = 3) -> DataFrame:
    """flags (probes that hold) and difficult: at least `least` do."""
    flags = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in probes.items())))
    return df.withColumn("flags", flags).withColumn("difficult", F.size("flags") >= least)


def compare_numeric(annotated: DataFrame, extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, class, severe: how an annotation and an extracted fact of the same keys differ; rows of one side stay."""
    cols = ("value", "currency", "period", "basis")
    a = annotated.select(*keys, *(F.col(c).alias(f"a_{c}") for c in cols), F.lit(1).alias("_a"))
    e = extracted.select(*keys, *(F.col(c).alias(f"e_{c}") for c in cols), F.lit(1).alias("_e"))
    j = a.join(e, list(keys), "full_outer")
    x, y = F.col("a_value"), F.col("e_value")
    ratio = F.try_divide(F.greatest(F.abs(x), F.abs(y)), F.least(F.abs(x), F.abs(y)))
    kind = F.when(F.col("_e").isNull(), "annotation_only").when(F.col("_a").isNull(), "extraction_only").when(~F.col("a_period").eqNullSafe(F.col("e_period")), "period").when(~F.col("a_currency").eqNullSafe(F.col("e_currency")), "currency").when(~F.col("a_basis").eqNullSafe(F.col("e_basis")), "basis").when(x == y, "agreed").when(x == -y, "sign").when(ratio.isin(1e3, 1e6, 1e9), "scale").otherwise("value")
    return j.select(*keys, kind.alias("class"), kind.isin("sign", "scale", "period", "basis").alias("severe"))
