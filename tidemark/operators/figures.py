"""Figures and excerpts of filings: tagged facts, table figures, windows around terms.

A document stays one row until its hits are known: all steps before are array functions on that row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import unescape

# Tags of the metrics that are taken from tagged facts.
METRIC_TAGS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "operating_profit": ["OperatingIncomeLoss"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForAdditionsToPropertyPlantAndEquipment"],
    "impairment_charges": ["AssetImpairmentCharges", "GoodwillAndIntangibleAssetImpairment"],
    "restructuring_charges": ["RestructuringCharges", "RestructuringAndRelatedCostIncurredCost"],
    "inventory": ["InventoryNet"],
    "receivables": ["AccountsReceivableNetCurrent"],
}
# Currencies of units, in order of priority, and the shortest periods in days of a year's and a year to date's facts.
CURRENCIES = ["USD", "GBP", "EUR", "JPY", "CNY"]
YEAR_DAYS, YEAR_TO_DATE_DAYS = 300, 120
# Metrics of table rows by their labels, in order of priority.
METRIC_LABELS = {
    "adjusted_operating_margin": r"adjusted operating margin",
    "operating_margin": r"(?<!adjusted )operating margin",
    "adjusted_ebitda": r"adjusted (?:ebitda|earnings before interest,? taxes,? depreciation and amorti[sz]ation)",
    "ebitda": r"(?<!adjusted )(?:ebitda|earnings before interest,? taxes,? depreciation and amorti[sz]ation)",
    "adjusted_operating_profit": r"adjusted operating (?:profit|income)",
    "operating_profit": r"(?<!adjusted )operating (?:profit|income)",
    "free_cash_flow": r"free cash flow",
    "cash_conversion": r"cash conversion",
    "net_debt": r"net debt",
    "net_cash": r"net cash",
    "gross_margin": r"gross margin",
    "revenue": r"(?:revenue|net sales)",
    "capex": r"(?:capital expenditure|capital expenditures|capex)",
    "impairment": r"impairment (?:charge|charges|loss|losses)",
    "restructuring_charge": r"restructuring (?:charge|charges|cost|costs)",
}
# Words that tell a table's scale, and signs of currencies, in order of priority.
SCALES = {"in billions": 1_000_000_000, "in millions": 1_000_000, "in thousands": 1_000}
SIGNS = {"£": "GBP", "$": "USD", "€": "EUR"}

#: Signs that stand between the cells and rows of a document while its references are decoded.
_CELL, _ROW = "\x01", "\x02"
_ALL = 1 << 30


def _rest(parts: Column) -> Column:
    return F.slice(parts, 2, _ALL)


def _blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def table_rows(html: Column) -> Column:
    """array<array<string>>: the cells of all table rows, tags off, references decoded, white space collapsed.

    A cell or row without an end tag before the next one begins is left out, as are rows without cells.
    """
    plain = F.translate(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), _CELL + _ROW, "  ")
    inside = lambda parts, end: F.transform(F.filter(_rest(parts), lambda p: p.rlike(end)), lambda p: F.split(p, end, 2)[0])
    rows = inside(F.split(plain, r"(?i)<tr\b[^>]*>"), r"(?i)</tr\s*>")
    cells = F.transform(rows, lambda r: inside(F.split(r, r"(?i)<t[dh]\b[^>]*>"), r"(?i)</t[dh]\s*>"))
    kept = F.filter(cells, lambda r: F.size(r) > 0)
    joined = unescape(F.regexp_replace(F.array_join(F.transform(kept, lambda r: F.array_join(r, _CELL)), _ROW), "<[^>]*>", ""))
    split = F.transform(F.split(joined, _ROW), lambda r: F.transform(F.split(r, _CELL), _blanks))
    return F.when(F.size(kept) > 0, split).otherwise(F.array().cast("array<array<string>>"))


def _figure(cell: Column) -> Column:
    """A cell's number without separators and signs of currency or percent; in parentheses it is negative; else null."""
    plain = F.regexp_replace(F.trim(cell), "[,£$€]", "")
    digits = F.rtrim(F.btrim(plain, F.lit("() ")), F.lit("%"))
    value = F.when(digits.rlike(r"^[-+]?\d+(?:\.\d+)?$"), digits).try_cast("double")
    return F.when(plain.startswith("(") & plain.endswith(")"), -F.abs(value)).otherwise(value)


def _first(tests: list[tuple[Column, object]]) -> Column:
    out = F
    for test, value in tests:
        out = out.when(test, value)
    return out


def table_figures(df: DataFrame, html: str, key: str, metrics: dict[str, str] = METRIC_LABELS) -> DataFrame:
    """key, metric, place, value, unit, scale, currency, year, basis, evidence: figures of the rows that a metric names.

    A row's metric is the first whose pattern its first cell has; all cells after it that are numbers are
    its figures. Years are those of the first row of the document with any, told from that row on: the
    figure at a place has the year at that place, null beyond them. Margins and conversion are percent;
    other figures take the scale that the first eight rows tell and the currency whose sign the document
    has. A metric's equal figure at the same place is told once, by the first row. `key` names one document.
    """
    rows = df.select(key, F.col(html).alias("_h"), table_rows(F.col(html)).alias("_rows"))
    named = lambda r: F.regexp_extract_all(F.array_join(r, " "), F.lit(r"(?U)\b(?:19|20)\d{2}\b"), F.lit(0))
    head = F.lower(F.array_join(F.flatten(F.slice("_rows", 1, 8)), " "))
    scale = _first([(F.contains(head, F.lit(k)), v) for k, v in SCALES.items()]).otherwise(1).cast("long")
    currency = _first([(F.contains("_h", F.lit(k)), v) for k, v in SIGNS.items()])
    lines = rows.withColumn("_years", F.transform("_rows", named)).select(
        key,
        scale.alias("_scale"),
        currency.alias("_currency"),
        F.get(F.filter("_years", lambda y: F.size(y) > 0), F.lit(0)).alias("_years"),
        F.array_position(F.transform("_years", lambda y: F.size(y) > 0), True).alias("_since"),
        F.posexplode("_rows").alias("_row", "_r"),
    )
    label = F.lower(F.get("_r", F.lit(0)))
    metric = _first([(label.rlike(p), k) for k, p in metrics.items()])
    hits = lines.withColumn("metric", metric).where("metric is not null")
    values = F.filter(F.transform(_rest(F.col("_r")), _figure), lambda v: v.isNotNull())
    each = hits.select("*", F.posexplode(values).alias("place", "_v"))
    percent = F.contains("metric", F.lit("margin")) | (F.col("metric") == "cash_conversion")
    year = F.when((F.col("_since") > 0) & (F.col("_row") + 1 >= F.col("_since")), F.get("_years", F.col("place"))).try_cast("int")
    applied = F.when(percent, 1).otherwise(F.col("_scale"))
    told = each.select(
        key,
        "metric",
        "place",
        "_v",
        "_row",
        F.struct(
            (F.col("_v") * applied).alias("value"),
            F.when(percent, "percent").otherwise("currency").alias("unit"),
            applied.cast("long").alias("scale"),
            F.when(~percent, F.col("_currency")).alias("currency"),
            year.alias("year"),
            F.when(F.col("metric").startswith("adjusted_"), "adjusted").otherwise("statutory_or_reported").alias("basis"),
            F.array_join("_r", " | ").alias("evidence"),
        ).alias("_f"),
    )
    return told.groupBy(key, "metric", "place", "_v").agg(F.min_by("_f", "_row").alias("_f")).select(key, "metric", "place", "_f.*")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag's head; null where it has none."""
    found = F.regexp_extract_all(F.regexp_extract(tag, r"^<[^>]*>", 0), F.lit(rf"(?is)(?<![\w:-]){name}\s*=\s*(['\"])(.*?)\1"), F.lit(2))
    # Reversed, the matches are looked for once, not once more for their number.
    return F.get(F.reverse(found), F.lit(0))


def _inner(tag: Column, name: str) -> Column:
    """The text right after the first inner tag of a name; null where there is none."""
    return F.nullif(F.regexp_extract(tag, rf"(?i)<xbrli:{name}>([^<]+)", 1), F.lit(""))


def _latest(entries: Column) -> Column:
    """A map of (k, v) entries; of equal keys the last counts."""
    ordered = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
    # The sorted array is bound once, not sorted again for each entry.
    last = F.get(F.transform(F.array(ordered), lambda o: F.filter(o, lambda e, i: F.coalesce(F.get(o, i + 1)["k"] != e["k"], F.lit(True)))), F.lit(0))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def ixbrl_facts(df: DataFrame, html: str, key: str, report_end: str | None = None, metrics: dict[str, list[str]] = METRIC_TAGS) -> DataFrame:
    """Facts of known tags in contexts without dimensions.

    key, metric, tag, value, raw_value, currency, unit, scale, sign, context, start_on, end_on, role,
    basis, evidence. `report_end` is the column with the day (ISO) on which a fact's period must end; without it
    all periods count. Money is told in millions. Roles are a year, a year to date, a quarter (told by
    days) and an instant. Equal facts of a metric, period, role, basis and currency are told once, by the
    first. One pass takes all tags of a document as an array; contexts and units are maps in that row, so
    that documents meet no shuffle but the last one by `key`, which names one document.
    """
    pattern = r"(?is)<(xbrli:context|xbrli:unit|ix:nonFraction)\b[^>]*>.*?</\1>"
    known = F.create_map(*(F.lit(x) for m, tags in metrics.items() for t in tags for x in (t, m)))
    kind = lambda name: F.filter("_tags", lambda t: F.lower(F.substring(t, 2, len(name))) == name)
    context = lambda t: F.struct(_attribute(t, "id").alias("k"), F.struct(_inner(t, "startDate").alias("start_on"), F.coalesce(_inner(t, "endDate"), _inner(t, "instant")).alias("end_on"), t.rlike(r"(?i)xbrldi:(?:explicitMember|typedMember)").alias("split")).alias("v"))

    def unit(t: Column) -> Column:
        measures = F.array_join(F.regexp_extract_all(t, F.lit(r"(?i)<xbrli:measure>([^<]+)"), F.lit(1)), " ")
        currency = _first([(F.contains(measures, F.lit(f"iso4217:{c}")), c) for c in CURRENCIES])
        kind = F.when(currency.isNotNull(), "currency").when(F.contains(F.lower(measures), F.lit("shares")), "shares").otherwise("pure")
        return F.struct(_attribute(t, "id").alias("k"), F.struct(currency.alias("currency"), kind.alias("unit")).alias("v"))

    def named(t: Column) -> Column:
        return F.struct(t.alias("t"), F.regexp_extract(t, r"^<[^>]*>", 0).alias("head"), F.coalesce(_attribute(t, "name"), F.lit("")).alias("name"))

    def tagged(n: Column) -> Column:
        return F.struct(n["t"].alias("t"), n["head"].alias("head"), n["name"].alias("name"), F.substring_index(n["name"], ":", -1).alias("tag"))

    def fact(n: Column) -> Column:
        t, head, name, tag = (n[c] for c in ("t", "head", "name", "tag"))
        attributes = {"context": "contextref", "unit_id": "unitref", "scale": "scale", "sign": "sign"}
        text = F.translate(F.regexp_replace(F.regexp_replace(t, r"^<[^>]*>|</[^>]*>$", ""), "<[^>]+>", ""), _ROW, " ")
        return F.struct(name.alias("name"), tag.alias("tag"), F.try_element_at(known, tag).alias("metric"), *(_attribute(head, a).alias(c) for c, a in attributes.items()), text.alias("text"), t.alias("evidence"))

    tags = df.select(key, *([F.col(report_end).alias("_end")] if report_end else []), F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("_tags"))
    entries = lambda made, end: F.filter(made, lambda e: e["k"].isNotNull() & (e["k"] != "") & (e["v"]["end_on"].isNotNull() if end else F.lit(True)))
    read = tags.select(
        *tags.columns[:-1],
        entries(F.transform(kind("xbrli:context"), context), True).alias("_contexts"),
        entries(F.transform(kind("xbrli:unit"), unit), False).alias("_units"),
        # Each step is bound by its transform, and facts of unknown tags leave before the others' attributes are read.
        F.transform(F.filter(F.transform(F.transform(kind("ix:nonfraction"), named), tagged), lambda n: F.try_element_at(known, n["tag"]).isNotNull()), fact).alias("_facts"),
    )
    maps = read.select(*tags.columns[:-1], _latest(F.col("_contexts")).alias("_contexts"), _latest(F.col("_units")).alias("_units"), "_facts", F.split(unescape(F.array_join(F.transform("_facts", lambda f: f["text"]), _ROW)), _ROW).alias("_texts"))
    joined = F.transform("_facts", lambda f, i: F.struct(f.alias("f"), F.trim(F.get("_texts", i)).alias("raw_value"), F.try_element_at("_contexts", f["context"]).alias("c"), F.try_element_at("_units", f["unit_id"]).alias("u")))
    fits = lambda x: x["c"].isNotNull() & ~x["c"]["split"] & (x["c"]["end_on"] == F.col("_end") if report_end else F.lit(True))
    rows = maps.select(key, F.posexplode(F.filter(joined, fits)).alias("_at", "x")).select(key, "_at", "x.f.*", "x.raw_value", "x.c.start_on", "x.c.end_on", F.col("x.u").alias("_unit"))
    raw = F.col("raw_value")
    negative = (F.col("sign") == "-") | (raw.startswith("(") & raw.endswith(")"))
    number = F.regexp_replace(F.btrim(raw, F.lit("()")), r"[^0-9.\-]", "").try_cast("double")
    sign = F.when(F.coalesce(negative, F.lit(False)) & (number > 0), -1).otherwise(1)
    power = F.coalesce("scale", F.lit("0")).try_cast("int")
    base = number * sign * F.pow(F.lit(10.0), power)
    currency = F.col("_unit.currency")
    days = F.coalesce(F.datediff(F.to_date("end_on"), F.to_date("start_on")), F.lit(0))
    role = F.when(days >= YEAR_DAYS, "current_fy").when(days >= YEAR_TO_DATE_DAYS, "current_ytd").when(F.col("start_on").isNotNull(), "current_quarter").otherwise("current_instant")
    told = rows.select(
        key,
        "_at",
        "metric",
        F.when(currency.isNotNull(), base / 1_000_000).otherwise(base).alias("value"),
        currency.alias("currency"),
        "start_on",
        "end_on",
        role.alias("role"),
        F.when(F.lower("name").startswith("us-gaap:"), "statutory").otherwise("company_adjusted_or_custom").alias("basis"),
        F.struct("tag", "raw_value", F.when(currency.isNotNull(), "million").otherwise(F.coalesce("_unit.unit", F.lit("unknown"))).alias("unit"), power.alias("scale"), sign.alias("sign"), "context", "evidence").alias("_f"),
    ).where("value is not null")
    same = ["metric", "start_on", "end_on", "role", "basis", "currency", "value"]
    return told.groupBy(key, *same).agg(F.min_by("_f", "_at").alias("_f")).select(key, "metric", "_f.tag", "value", "_f.raw_value", "currency", "_f.unit", "_f.scale", "_f.sign", "_f.context", "start_on", "end_on", "role", "basis", "_f.evidence")


def primary_facts(facts: DataFrame, key: str, name: str = "metric") -> DataFrame:
    """One statutory fact for each document and name: the longest period, then the first by role and value.

    Facts without the column basis all count, as do those without role.
    """
    if "basis" in facts.columns:
        facts = facts.where("basis = 'statutory'")
    days = F.coalesce(F.datediff(F.to_date("end_on"), F.to_date("start_on")), F.lit(0))
    w = Window.partitionBy(key, name).orderBy(days.desc(), *(["role"] if "role" in facts.columns else ["start_on"]), "value")
    return facts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def excerpts(df: DataFrame, pages: Column, keys: Sequence[str], terms: Sequence[str], before: int = 180, after: int = 260, most: int = 8) -> DataFrame:
    """keys, n, page, term, start, stop, excerpt: the first `most` windows around terms, none of which meet.

    `pages` is an array of texts, whose white space is collapsed. Pages are read in order, on each the
    terms in order, of each its matches in order, whatever their case; a window of `before` characters
    before and `after` after a match is left out if it meets one taken on its page, and reading ends with
    `most` of a document (null: none ends it). start and stop are places in the collapsed page.

    The choice is a fold over the pages of a row. Between two matches of a term stand the parts that the
    page falls into at it, so their lengths tell the places.
    """
    kind = "array<struct<page:int,term:string,start:int,stop:int>>"

    def choose(taken: Column, page: Column, term: str) -> Column:
        parts = F.split(page["text"], rf"(?iu){re.escape(term)}")
        size = len(term)

        def step(state: Column, part: Column) -> Column:
            at = state["at"] + F.length(part)
            window = F.struct(page["page"].alias("page"), F.lit(term).alias("term"), F.greatest(at - before, F.lit(0)).alias("start"), F.least(at + size + after, page["size"]).alias("stop"))

            def take(w: Column) -> Column:
                met = F.exists(state["taken"], lambda x: (x["page"] == w["page"]) & ~((w["stop"] < x["start"]) | (w["start"] > x["stop"])))
                full = F.size(state["taken"]) >= most if most is not None else F.lit(False)
                return F.when(full, state["taken"]).when(met, state["taken"]).otherwise(F.concat(state["taken"], F.array(w).cast(kind)))

            # The window is computed once, and its places are compared.
            return F.struct((at + size).alias("at"), F.get(F.transform(F.array(window), take), F.lit(0)).alias("taken"))

        begun = F.struct(F.lit(0).alias("at"), taken.alias("taken"))
        return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), begun, step)["taken"]

    def read(taken: Column, p: Column) -> Column:
        for term in terms:
            taken = choose(taken, p, term)
        return taken

    numbered = F.transform(pages, lambda p, i: F.struct((i + 1).cast("int").alias("page"), _blanks(F.coalesce(p, F.lit(""))).alias("text")))
    rows = df.select(*keys, numbered.alias("_p")).withColumn("_p", F.transform("_p", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), F.length(p["text"]).alias("size"))))
    found = rows.select(*keys, "_p", F.aggregate("_p", F.array().cast(kind), read).alias("_w"))
    cut = F.transform("_w", lambda w: F.struct(w["page"].alias("page"), w["term"].alias("term"), w["start"].alias("start"), w["stop"].alias("stop"), F.substring(F.get("_p", w["page"] - 1)["text"], w["start"] + 1, w["stop"] - w["start"]).alias("excerpt")))
    return found.select(*keys, F.posexplode(cut).alias("n", "_x")).select(*keys, "n", "_x.*")
