"""Queries of roles, places, skills, changes, amounts and boards over all sentences and pages; the oracles state the order of the rules as cases.

What a rule reads is a sentence of a document behind words that its place picks, so that several rules may
hold for one sentence and the first has to win. Signs beyond ASCII are left out of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse as pa
from tidemark.functions import text as tx
from tidemark.operators import extraction as ex
from tidemark.plans.candidates import _list, _pick
from tidemark.plans.documents import SENTENCES
from tidemark.plans.registry import query
from tidemark.sources import postings as po

RANKS = ["Chief", "Vice President,", "VP Group", "Head of", "Director of", "Manager,", "Team Lead", "Senior", "Supervisor", ""]
AREAS = ["Data Engineer", "AI Platform", "Software Security", "Product Manager", "Sales Revenue", "Brand Content", "Tax Accounting", "Talent", "Privacy Counsel", "Customer Success", "Plant Sourcing", "Gardens", "Kitchen", "SQL Analytics", "Python on AWS", "SAP and Oracle", "Machine Learning in Java"]
WHERE = ["Remote", "Leeds", "Hybrid site", "Multiple", "", "Austin"]
LANDS = ["United Kingdom", "France, Germany", "USA", "", "Canada", "Utopia", "Ireland", "Pune, India"]
TURNS = ["Demand increased and", "Capacity was reduced,", "Sites opened as others closed;", "Growth and pressure met:", "The directors met.", "Basis of preparation:", "Principal risks:", "Litigation of the year ended", "Nothing else:"]
SUMS = ["revenue of ${} million", "USD {} bn", "a EUR {}k grant", "up {} per cent", "-{}% margin", "leverage of {}x", "GBP {}", "no figure"]

STEMS = f"""{SENTENCES}, e as (select doc_id, s, unnest(range(len(s))) as position from x),
z as materialized (select doc_id, position::integer as position, doc_id + 5 * position as k, doc_id + 7 * position as j, regexp_replace(s[position + 1], '[^ -~]', '', 'g') as plain from e)"""


def _stems(t):
    rows = t.documents.select("doc_id", F.posexplode(ex.sentences(F.col("text"))).alias("position", "s"))
    place = lambda n: F.col("doc_id") + n * F.col("position")
    return rows.select("doc_id", "position", place(5).alias("k"), place(7).alias("j"), F.regexp_replace("s", "[^ -~]", "").alias("plain"))


def _first(table: dict[str, list[str]], column: str, other: str) -> str:
    """The first name of the table one of whose words a column has, in SQL."""
    return f"case {' '.join(f'when {_any(words, column)} then {_quoted(name)}' for name, words in table.items())} else {other} end"


def _any(words: list[str], column: str) -> str:
    return "(" + " or ".join(f"contains({column}, {_quoted(w)})" for w in words) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A title behind and before a blank, so that words at its ends are met.
PADDED = "(' ' || x || ' ')"
TITLE = f"{_list(RANKS, 'k')} || ' ' || {_list(AREAS, 'j')}"


def _title():
    return F.concat(_pick(RANKS, F.col("k")), F.lit(" "), _pick(AREAS, F.col("j")))


@query(f"""with {STEMS}, t as (select doc_id, position, lower({TITLE}) as title, lower(plain) as department from z)
select doc_id, position, {_first(pa.FUNCTIONS, "(' ' || title || ' ' || department || ' ')", "'other_unknown'")} as function, {_first(pa.SENIORITY, "title", "case when trim(title) = '' then 'unknown' else 'individual_contributor' end")} as seniority from t""")
def sentence_roles(t):
    s = _stems(t)
    return s.select("doc_id", "position", pa.job_function(_title(), F.col("plain")).alias("function"), pa.job_seniority(_title()).alias("seniority"))


@query(f"""with {STEMS}, t as (select doc_id, position, lower({TITLE} || ' ' || plain) as x from z), n as (select doc_id, position, list_sort(list_filter([{', '.join(f"case when {_any(w, PADDED)} then {_quoted(k)} end" for k, w in pa.TECHNOLOGIES.items())}], lambda v: v is not null)) as n from t)
select doc_id, position, array_to_string(n, ',') as names, array_to_string(list_filter([{', '.join(f"case when list_has_any(n, {m}) then {_quoted(k)} end" for k, m in pa.TECHNOLOGY_FAMILIES.items())}], lambda v: v is not null), ',') as families from n""")
def sentence_skills(t):
    f = pa.technologies(_title(), F.col("plain"))
    return _stems(t).select("doc_id", "position", f.alias("f")).select("doc_id", "position", F.array_join("f.names", ",").alias("names"), F.array_join("f.families", ",").alias("families"))


@query(f"""with {STEMS}, t as (select doc_id, position, {_list(WHERE, 'k')} || ', ' || plain || ', ' || {_list(LANDS, 'j')} as x from z),
p as (select *, list_filter(list_transform(string_split(x, ','), lambda w: trim(w, ' ')), lambda w: w <> '') as p from t)
select doc_id, position, case {' '.join(f"when contains(' ' || lower(x), {_quoted(w)}) then {_quoted(n)}" for w, n in pa.COUNTRIES.items())} end as country,
 case when len(p) >= 3 then p[len(p) - 1] end as region, case when not regexp_matches(p[1], '(?i)\\b(remote|hybrid|multiple|various)\\b') then p[1] end as city from p""")
def sentence_places(t):
    where = F.concat(_pick(WHERE, F.col("k")), F.lit(", "), F.col("plain"), F.lit(", "), _pick(LANDS, F.col("j")))
    return _stems(t).select("doc_id", "position", pa.geography(where).alias("g")).select("doc_id", "position", "g.country", "g.region", "g.city")


def _has(pattern: str, column: str) -> str:
    return f"regexp_matches({column}, {_quoted(pattern)})"


@query(f"""with {STEMS}, t as (select doc_id, position, {_list(TURNS, 'k')} || ' ' || plain as s, {_list(TURNS, 'j')} as h from z),
f as (select *, {_has(tx.UP, 'lower(s)')} as u, {_has(tx.DOWN, 'lower(s)')} as d, lower(h || ' ' || s) as b from t)
select doc_id, position, case when u and d then 'mixed' when u then 'increase_or_improvement' when d then 'decrease_or_deterioration' else 'not_directional_or_unknown' end as polarity,
 case {' '.join(f"when {_has(p, 'b')} then '{n}'" for n, p in tx.ZONES.items())} else 'body_narrative' end as zone from f""")
def sentence_changes(t):
    s, h = F.concat(_pick(TURNS, F.col("k")), F.lit(" "), F.col("plain")), _pick(TURNS, F.col("j"))
    return _stems(t).select("doc_id", "position", tx.polarity(s).alias("polarity"), tx.source_zone(h, s).alias("zone"))


MONEY = r"(?i)([$]|\bGBP|\bUSD|\bEUR)\s*(-?\d[\d,]*(?:\.\d+)?)\s*(bn|billion|mn|million|m|k|thousand)?\b"
PERCENT = r"(?i)([-+]?\d[\d,]*(?:\.\d+)?)\s*(?:%|percent|per cent)"
TIMES = r"(?i)(\d+(?:\.\d+)?)\s*x\b"


@query(f"""with {STEMS}, t as (select doc_id, position, replace({_list(SUMS, 'k')}, '{{}}', (j / 4.0)::decimal(38, 2)::varchar) || '. ' || plain as x from z),
g as (select *, upper(regexp_extract(x, '{MONEY}', 1)) as c, try_cast(replace(regexp_extract(x, '{MONEY}', 2), ',', '') as double) as m, lower(regexp_extract(x, '{MONEY}', 3)) as w, try_cast(replace(regexp_extract(x, '{PERCENT}', 1), ',', '') as double) as p, try_cast(regexp_extract(x, '{TIMES}', 1) as double) as r from t)
select doc_id, position, round(case when m is not null then m * case {' '.join(f"when w = '{k}' then {v}" for k, v in pa.SCALES.items())} else 1e-6 end when p is not null then p else r end, 9) as value,
 case when m is not null then case c when '$' then 'USD' else c end when p is not null then 'percent' when r is not null then 'ratio' end as unit from g""")
def sentence_amounts(t):
    figure = (F.col("j") / F.lit(4.0)).cast("decimal(38,2)").cast("string")
    x = F.concat(F.replace(_pick(SUMS, F.col("k")), F.lit("{}"), figure), F.lit(". "), F.col("plain"))
    return _stems(t).select("doc_id", "position", pa.amount(x).alias("a")).select("doc_id", "position", F.round("a.value", 9).alias("value"), "a.unit")


#: A host of each board, and one of none; a page's number is its label.
HOSTS = [("acme{}" if kind == "ends" else "acme{}." if kind == "has" else "") + (text + "com" if text.endswith(".") else text if "." in text else text + ".com") for kind, text, *_ in po.BOARDS] + ["jobs{}.example.com"]
HELD = {"is": "h = {}", "ends": "ends_with(h, {})", "has": "contains(h, {})"}


def _board(value) -> str:
    return "case " + " ".join(f"when {HELD[kind].format(_quoted(text))} then {value(text, provider, place, public)}" for kind, text, provider, place, public, _ in po.BOARDS)


NAMED = {"path": lambda text: "nullif(split_part(p, '/', 1), '')", "rest": lambda text: f"left(h, length(h) - {len(text)})", "label": lambda text: "split_part(h, '.', 1)", None: lambda text: "null"}


@query(f"""with u as (select page_id, replace({_list(HOSTS, 'page_id')}, '{{}}', page_id::varchar) as h, 'role' || (page_id % 11)::varchar || '/' || page_id::varchar as p from pages)
select page_id, {_board(lambda text, provider, place, public: _quoted(provider))} else 'unknown' end as provider, {_board(lambda text, provider, place, public: NAMED[place](text))} end as identifier, {_board(lambda text, provider, place, public: str(public).lower())} else false end as public_api from u""")
def page_boards(t):
    k = F.col("page_id")
    host = F.replace(_pick(HOSTS, k), F.lit("{}"), k.cast("string"))
    url = F.concat(F.lit("https://"), host, F.lit("/role"), (k % 11).cast("string"), F.lit("/"), k.cast("string"))
    return t.pages.select("page_id", po.detect_provider(url).alias("p")).select("page_id", "p.provider", "p.identifier", "p.public_api")
