"""Numbers, dates, places and roles out of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions by words in title and department, in order of priority.
FUNCTIONS = {
    "data_ai": ["data scientist", "data engineer", "machine learning", "artificial intelligence", " ai ", "analytics"],
    "engineering": ["engineer", "developer", "software", "platform", "infrastructure", "security"],
    "product": ["product manager", "product design", "product operations"],
    "sales": ["sales", "account executive", "business development", "revenue"],
    "marketing": ["marketing", "communications", "brand", "content"],
    "finance": ["finance", "financial", "accountant", "accounting", "treasury", "tax"],
    "hr_people": ["human resources", "people operations", "recruit", "talent", "compensation"],
    "legal_compliance": ["legal", "counsel", "compliance", "privacy"],
    "customer_service": ["customer success", "customer support", "service desk", "technical support"],
    "operations": ["operations", "procurement", "sourcing", "supply chain", "manufacturing", "plant", "production"],
}
# Seniority by words in the title, in order of priority.
SENIORITY = {"vp_executive": ["chief", "vice president", "vp ", "vp,", "head of", "president"], "director": ["director"], "manager": ["manager", "team lead", "engineering lead", "supervisor"]}
# Countries by words in a location, in order of priority.
COUNTRIES = {"united states": "United States", " usa": "United States", "united kingdom": "United Kingdom", " uk": "United Kingdom", "canada": "Canada", "germany": "Germany", "france": "France", "ireland": "Ireland", "india": "India", "australia": "Australia", "singapore": "Singapore", "japan": "Japan", "netherlands": "Netherlands", "spain": "Spain", "italy": "Italy"}
# Technologies by words, and their families.
TECHNOLOGIES = {
    "Python": ["python"],
    "Java": ["java"],
    "SQL": [" sql", "sql "],
    "AWS": ["aws", "amazon web services"],
    "Azure": ["azure"],
    "GCP": ["gcp", "google cloud"],
    "Kubernetes": ["kubernetes"],
    "Snowflake": ["snowflake"],
    "Databricks": ["databricks"],
    "SAP": [" sap", "sap "],
    "Oracle": ["oracle"],
    "Salesforce": ["salesforce"],
    "Workday": ["workday"],
    "AI/ML": ["machine learning", "artificial intelligence", " ai ", " ml "],
}
TECHNOLOGY_FAMILIES = {"software_data_languages": ["Python", "Java", "SQL"], "cloud_platforms": ["AWS", "Azure", "GCP", "Kubernetes"], "data_ai": ["Snowflake", "Databricks", "AI/ML"], "enterprise_applications": ["SAP", "Oracle", "Salesforce", "Workday"]}
SCALES = {"bn": 1000.0, "billion": 1000.0, "m": 1.0, "mn": 1.0, "million": 1.0, "k": 0.001, "thousand": 0.001}


def _once(value: Column, use) -> Column:
    """use(value), with value computed once for all the rules that read it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _number(text: Column) -> Column:
    return F.nullif(F.replace(text, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def percentage(text: Column) -> Column:
    """The first signed number before %, percent or per cent; null if there is none."""
    return _number(F.regexp_extract(text, r"(?i)([-+]?\d[\d,]*(?:\.\d+)?)\s*(?:%|percent|per cent)", 1))


def amount(text: Column) -> Column:
    """value and unit: money in millions with its currency, else a percentage, else a ratio with x; nulls if none."""
    money = r"(?i)(£|\$|€|\bGBP|\bUSD|\bEUR)\s*(-?\d[\d,]*(?:\.\d+)?)\s*(bn|billion|mn|million|m|k|thousand)?\b"
    sign = F.upper(F.regexp_extract(text, money, 1))
    currency = F.when(sign.isin("£", "GBP"), "GBP").when(sign.isin("$", "USD"), "USD").when(sign.isin("€", "EUR"), "EUR")
    scale = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv)), F.lower(F.regexp_extract(text, money, 3))), F.lit(1e-6))
    ratio = _number(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*x\b", 1))
    m = _number(F.regexp_extract(text, money, 2)) * scale
    pair = lambda v, u: F.struct(v.cast("double").alias("value"), u.alias("unit"))
    none = F.lit(None).cast("string")
    return F.when(currency.isNotNull() & m.isNotNull(), pair(m, currency)).when(percentage(text).isNotNull(), pair(percentage(text), F.lit("percent"))).when(ratio.isNotNull(), pair(ratio, F.lit("ratio"))).otherwise(pair(F.lit(None), none))


def cell_number(text: Column) -> Column:
    """A table cell's number: parentheses are negative, dashes and other text null."""
    plain = F.regexp_replace(F.trim(text), r"[,$£€%\s]", "")
    negative = plain.rlike(r"^\(.*\)$")
    value = F.regexp_replace(plain, r"[()]", "").try_cast("double")
    return F.when(negative, -value).otherwise(value)


def ixbrl_number(text: Column, sign: Column) -> Column:
    """The number of a tagged fact: inner tags off, negative by sign attribute or parentheses."""
    value = cell_number(F.regexp_replace(text, "<[^>]*>", ""))
    return F.when(sign == "-", -F.abs(value)).otherwise(value)


def iso_timestamp(text: Column) -> Column:
    """An ISO timestamp, Z as UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def job_function(title: Column, department: Column) -> Column:
    """The first function whose words occur."""
    text = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", title, F.coalesce(department, F.lit("")))), F.lit(" "))
    return _once(text, lambda x: _first_words(x, FUNCTIONS, F.lit("other_unknown")))


def _first_words(text: Column, table: dict[str, list[str]], out: Column) -> Column:
    for k, words in reversed(table.items()):
        out = F.when(_any(text, words), k).otherwise(out)
    return out


def job_seniority(title: Column) -> Column:
    """vp_executive, director, manager, individual_contributor or unknown."""
    return _once(F.lower(title), lambda x: _first_words(x, SENIORITY, F.when(F.trim(x) != "", "individual_contributor").otherwise("unknown")))


# Wording of functions and ranks of the shorter classification, in order.
SHORT_FUNCTIONS = {
    "operations": r"operations?|plant|production|warehouse|quality",
    "procurement": r"procurement|purchasing|sourcing|buyer",
    "transformation": r"transformation|change|programme|program manager",
    "finance": r"finance|financial|accountant|treasury",
    "ai_data": r"\bai\b|data|machine learning|analytics",
    "manufacturing": r"manufactur|factory|machinist|engineering",
}
SHORT_RANKS = {"senior": r"chief|director|vice president|\bvp\b|head of", "manager": r"manager|lead"}


def _first_pattern(text: Column, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, pattern in reversed(table.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def infer_function(title: Column, department: Column | None = None) -> Column:
    """The first of six functions that title or department names, else other."""
    return _first_pattern(F.lower(title if department is None else F.concat_ws(" ", title, department)), SHORT_FUNCTIONS, "other")


def infer_seniority(title: Column) -> Column:
    """senior, manager or individual_contributor."""
    return _first_pattern(F.lower(title), SHORT_RANKS, "individual_contributor")


def geography(location: Column) -> Column:
    """country, region, city of a location (H20): the first country named, the last part but one of three, the first part unless remote."""
    parts = F.filter(F.transform(F.split(location, ","), lambda p: F.trim(p)), lambda p: p != "")
    padded = F.concat(F.lit(" "), F.lower(location))
    country = F.lit(None).cast("string")
    for word, name in reversed(COUNTRIES.items()):
        country = F.when(F.contains(padded, F.lit(word)), name).otherwise(country)
    city = F.get(parts, F.lit(0))
    return F.struct(country.alias("country"), F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 2)).alias("region"), F.when(~city.rlike(r"(?i)\b(remote|hybrid|multiple|various)\b"), city).alias("city"))


def technologies(title: Column, department: Column) -> Column:
    """names, sorted, and families of technologies named in title and department."""
    text = F.concat(F.lit(" "), F.lower(F.concat_ws(" ", title, department)), F.lit(" "))
    names = _once(text, lambda x: F.array_sort(F.array_compact(F.array(*(F.when(_any(x, words), F.lit(k)) for k, words in TECHNOLOGIES.items())))))
    families = lambda n: F.array_compact(F.array(*(F.when(F.arrays_overlap(n, F.array(*map(F.lit, members))), F.lit(k)) for k, members in TECHNOLOGY_FAMILIES.items())))
    return _once(names, lambda n: F.struct(n.alias("names"), families(n).alias("families")))


def normal_location(location: Column, aliases: dict[str, str]) -> Column:
    """Dashes and spaces made even, whole locations replaced by their alias."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(location, "[–—]", "-"), r"\s+", " "))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), F.lower(plain)), plain)


def backoff_hours(failures: Column, healthy: Column) -> Column:
    """min(24 * 2 ** (failures - 1), 168); 0 if healthy."""
    return F.when(healthy, 0).otherwise(F.least(24 * F.pow(F.lit(2), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(8))), F.lit(168)).cast("int"))


def cik(number: Column) -> Column:
    """Ten digits with zeros before."""
    return F.lpad(number.cast("string"), 10, "0")


def period_matches(text: Column, end: Column) -> Column:
    """Whether the end date stands in the text, or the text is its year, with or without fy."""
    year = F.date_format(end, "yyyy")
    return F.contains(text, F.date_format(end, "yyyy-MM-dd")) | (F.lower(F.trim(text)) == year) | (F.lower(F.trim(text)) == F.concat(F.lit("fy"), year))
