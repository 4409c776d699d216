"""Text functions on columns."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

# Words that carry no identity in names.
LEGAL_A = ["plc", "limited", "ltd", "holdings", "group", "the"]
LEGAL_B = ["plc", "limited", "ltd", "holdings", "group", "company", "co", "the"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_name(name: Column) -> Column:
    """Lower case, & as and, other signs as spaces, legal words left out (H1)."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return F.array_join(F.filter(F.split(plain, " +"), lambda w: ~w.isin(*LEGAL_A) & (w != "")), " ")


def normalize_supplier(name: Column) -> Column:
    """Lower case, signs as spaces, legal words taken out as whole words; double spaces may stay (H2)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), rf"\b({'|'.join(LEGAL_B)})\b", ""))


def normalize_key(value: Column) -> Column:
    """Lower case letters and digits only (H3)."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def collapse(value: Column) -> Column:
    """White space as one space, trimmed (H4)."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def tokens(text) -> Column:
    """All runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def jaccard(left, right, pattern: str = "([a-z0-9]+)", stop: Sequence[str] = (), empty: float = 1.0) -> Column:
    """Jaccard similarity of token sets; `empty` when neither has tokens (H5; H6 with [a-z]{3,}, stop words and 0)."""
    def bag(c):
        t = F.array_distinct(F.regexp_extract_all(F.lower(_c(c)), F.lit(pattern), F.lit(1)))
        return F.array_except(t, F.array(*map(F.lit, stop))) if stop else t

    a, b = bag(left), bag(right)
    return F.when(F.size(F.array_union(a, b)) == 0, empty).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


@pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, lower case with signs collapsed (H7; no native form)."""
    plain = lambda s: re.sub(r"\W+", " ", s or "").strip().lower()
    return pd.Series([difflib.SequenceMatcher(None, plain(a), plain(b)).ratio() for a, b in zip(left, right)], dtype="float64")


class _Signs(dict):
    """What str.translate puts for a sign: straight quotes, nothing for control characters but white space, else the sign."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = code if c.isspace() or unicodedata.category(c)[0] != "C" else None
        return self[code]


SIGNS = _Signs(str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'}))


@udf(StringType(), useArrow=False)
def visible_source_text(text: str | None) -> str | None:
    """NFKC, straight quotes, no control characters, white space collapsed (H23; NFKC has no native form).

    Texts come by hundreds, not by Arrow's batches of 10,000 whole texts, so few of them are in memory.
    """
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).translate(SIGNS).split())


@pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references as characters (for G1)."""
    return text.map(lambda s: None if s is None else html.unescape(s))


def event_fingerprint(company: Column, kind: Column, day: Column, text: Column) -> Column:
    """Hash of company, type, ISO year and week (not padded) and the sorted distinct tokens (H8)."""
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.weekofyear(day).cast("string"))
    return F.sha2(F.concat_ws("|", company.cast("string"), kind.cast("string"), week, F.array_join(F.array_sort(F.array_distinct(tokens(text))), " ")), 256)


def canonical_json(columns: Sequence[str]) -> Column:
    """A JSON object of string values with sorted keys and no spaces; null as null."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(quote(F.col(c).cast("string")), F.lit("null"))) for c in sorted(columns)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def row_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def snapshot_hash(ids: Column) -> Column:
    """Hash of a set of ids, the same in any order (H9)."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(ids), lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))), ","), F.lit("]")), 256)


def stable_id(prefix: str, value: Column, n: int = 12) -> Column:
    """A prefix and the first n hexadecimal digits of the value's hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, n))


def strip_html(text: Column) -> Column:
    """Tags as spaces, common references decoded, white space collapsed, empty as null."""
    plain = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.nullif(collapse(F.regexp_replace(plain, "<[^>]*>", " ")), F.lit(""))


# Wording of directions, and of zones in order.
UP = r"\b(?:increase[ds]?|grew|growth|improv(?:e|ed|ement)|accelerat(?:e|ed|ion)|expand(?:ed|ing|sion)|open(?:ed|ing))\b"
DOWN = r"\b(?:decrease[ds]?|declin(?:e|ed)|deteriorat(?:e|ed|ion)|contract(?:ed|ion)|reduc(?:e|ed|tion)|pressure|clos(?:e|ed|ure))\b"
ZONES = {
    "biography": r"\b(directors?|officers?|biograph|board of directors|executive profile)\b",
    "accounting_definition": r"\b(accounting polic|basis of preparation|non-gaap|alternative performance measure|definitions?)\b",
    "legal": r"\b(legal proceedings?|litigation|contingencies|claims and actions)\b",
    "risk": r"\b(risk factors?|principal risks?)\b",
}
FRAGMENT = r"\b(table|£m|\$m|€m|year ended)\b"


def polarity(span: Column) -> Column:
    """The direction of a sentence by its words of change."""
    up, down = F.lower(span).rlike(UP), F.lower(span).rlike(DOWN)
    return F.when(up & down, "mixed").when(up, "increase_or_improvement").when(down, "decrease_or_deterioration").otherwise("not_directional_or_unknown")


def source_zone(heading: Column, span: Column) -> Column:
    """The zone of a document by the words of a heading and span."""
    both = F.lower(F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), span))
    out = F.when(both.rlike(FRAGMENT) & F.contains(span, F.lit("\n")), "table_or_fragment").otherwise("body_narrative")
    for name, pattern in reversed(ZONES.items()):
        out = F.when(both.rlike(pattern), name).otherwise(out)
    return out


def truncate_context(text: Column, span: Column, most: int = 2400) -> Column:
    """The text cut to `most` characters around the span."""
    at = F.greatest(F.instr(text, span), F.lit(1))
    start = F.greatest(F.lit(1), F.least(at + F.length(span).cast("int") / 2 - most / 2, F.length(text) - most + 1)).cast("int")
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, start, F.lit(most)))


@pandas_udf(ArrayType(IntegerType()))
def span_offsets(text: pd.Series, span: pd.Series) -> pd.Series:
    """Zero-based starts of all occurrences of a literal that do not overlap, in linear time; the first is canonical.

    Null for a null text; no starts for a null or empty span. A native fold copies its array at each step.
    """

    def starts(s: str | None, span: str | None) -> list[int] | None:
        if s is None or not span:
            return None if s is None and span else []
        out, at = [], s.find(span)
        while at >= 0:
            out.append(at)
            at = s.find(span, at + len(span))
        return out

    return pd.Series([starts(a, b) for a, b in zip(text, span)], dtype=object)


def redact(text: Column, terms: Sequence[str], mask: str = "[redacted]") -> Column:
    """Each term replaced, longest first."""
    out = text
    for t in sorted(set(terms), key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, F.lit("(?i)" + re.escape(t)), F.lit(mask))
    return out
