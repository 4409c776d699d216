"""Tagged facts, table figures and excerpts; nulls, empty and long documents, repeats."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import figures


def context(name, start, end, more=""):
    days = f"<xbrli:startDate>{start}</xbrli:startDate><xbrli:endDate>{end}</xbrli:endDate>" if start else f"<xbrli:instant>{end}</xbrli:instant>"
    return f'<xbrli:context id="{name}"><xbrli:entity/>{more}<xbrli:period>{days}</xbrli:period></xbrli:context>'


def fact(name, ref, value, more='unitRef="usd"'):
    return f'<ix:nonFraction contextRef="{ref}" name="{name}" {more}>{value}</ix:nonFraction>'


UNITS = '<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="shares"><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>'
REPORT = "\n".join(
    [
        "<html>",
        context("year", "2024-01-01", "2024-12-31"),
        context("before", "2023-01-01", "2023-12-31"),
        context("nine", "2024-04-01", "2024-12-31"),
        context("last", "2024-10-01", "2024-12-31"),
        context("end", None, "2024-12-31"),
        context("part", "2024-01-01", "2024-12-31", "<xbrldi:explicitMember>x</xbrldi:explicitMember>"),
        UNITS,
        fact("us-gaap:Revenues", "year", "1,2<b>3</b>4.5", 'unitRef="usd" scale="6"'),
        fact("us-gaap:Revenues", "year", "1,234.5", 'unitRef="usd" scale="6"'),
        fact("us-gaap:Revenues", "before", "900", 'unitRef="usd" scale="6"'),
        fact("us-gaap:Revenues", "part", "7", 'unitRef="usd" scale="6"'),
        fact("us-gaap:OperatingIncomeLoss", "nine", "(20)"),
        fact("us-gaap:OperatingIncomeLoss", "last", "5,000,000", "unitRef='usd' sign='-'"),
        fact("own:InventoryNet", "end", "3&#46;5", 'unitRef="shares"'),
        fact("us-gaap:InventoryNet", "end", "4", 'unitRef="none" scale="3"'),
        fact("us-gaap:Goodwill", "end", "4"),
        fact("us-gaap:Revenues", "nowhere", "4"),
        fact("us-gaap:Revenues", "last", "—"),
        "</html>",
    ]
)


def test_tagged_facts(spark):
    df = spark.createDataFrame([(1, REPORT, "2024-12-31"), (2, REPORT, "2023-12-31"), (3, "", "2024-12-31"), (4, None, None)], "id int, html string, ends string")
    found = figures.ixbrl_facts(df, "html", "id", "ends")
    got = {(r.metric, r.role, r.basis): r for r in found.where("id = 1").collect()}
    assert set(got) == {("revenue", "current_fy", "statutory"), ("operating_profit", "current_ytd", "statutory"), ("operating_profit", "current_quarter", "statutory"), ("inventory", "current_instant", "company_adjusted_or_custom"), ("inventory", "current_instant", "statutory")}
    r = got["revenue", "current_fy", "statutory"]
    assert (r.tag, r.value, r.raw_value, r.currency, r.unit, r.scale, r.sign, r.context, r.start_on, r.end_on) == ("Revenues", 1234.5, "1,234.5", "USD", "million", 6, 1, "year", "2024-01-01", "2024-12-31")
    assert r.evidence == fact("us-gaap:Revenues", "year", "1,2<b>3</b>4.5", 'unitRef="usd" scale="6"')
    assert [(x.value, x.sign) for x in (got["operating_profit", k, "statutory"] for k in ("current_ytd", "current_quarter"))] == [(-2e-05, -1), (-5.0, -1)]
    assert (got["inventory", "current_instant", "company_adjusted_or_custom"].value, got["inventory", "current_instant", "company_adjusted_or_custom"].unit) == (3.5, "shares")
    assert (got["inventory", "current_instant", "statutory"].value, got["inventory", "current_instant", "statutory"].unit) == (4000.0, "unknown")
    assert [(r.value, r.end_on) for r in found.where("id = 2").collect()] == [(900.0, "2023-12-31")] and found.where("id > 2").count() == 0
    primary = figures.primary_facts(found.where("id = 1"), "id").collect()
    assert sorted((r.metric, r.role, r.value) for r in primary) == [("inventory", "current_instant", 4000.0), ("operating_profit", "current_ytd", -2e-05), ("revenue", "current_fy", 1234.5)]
    assert figures.ixbrl_facts(df, "html", "id").where("id = 1 and metric = 'revenue'").count() == 2
    assert figures.ixbrl_facts(df.limit(0), "html", "id", "ends").count() == 0


def test_a_long_report_is_read_in_one_pass(spark):
    """3.7 MB of a report with 2000 other facts and 400 contexts; of equal ids the last context counts."""
    rest = "".join(context(f"c{i}", "2024-01-01", "2024-12-31") + fact("us-gaap:Other", f"c{i}", i) * 5 for i in range(400))
    page = context("year", "2020-01-01", "2020-12-31") + rest + "<p>" + "text " * 600_000 + "</p>" + REPORT
    df = spark.createDataFrame([(k, page, "2024-12-31") for k in range(4)], "id int, html string, ends string").repartition(4)
    began = time.time()
    assert figures.ixbrl_facts(df, "html", "id", "ends").count() == 20
    assert time.time() - began < 60


def cells(label, *values):
    return "<tr><td>" + label + "</td>" + "".join(f"<td>{v}</td>" for v in values) + "</tr>"


def table(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    found = figures.table_figures(df, "html", "id").orderBy("id", "metric", "place")
    return [(r.id, r.metric, r.place, r.value, r.unit, r.scale, r.currency, r.year, r.basis) for r in found.collect()]


def test_table_figures(spark):
    page = "<p>£</p><table><tr><th>in millions</th></tr><tr><th></th><th>Year&nbsp;2024</th><th colspan=2>2023 </th></tr>" + cells("Revenue", "1,200", "(30)", "5") + cells("Adjusted <i>EBITDA</i>", "12<b>.5</b>") + cells("Operating margin", "5.2%", "-") + "</table>"
    late = "<table>" + cells("Net debt", "$4", "n/a", "x9") + cells("Heads", "2021 and 1999") + cells("Net debt", "$4", "6") + cells("Cash conversion", "80%") + "</table>"
    blank = "<table>" + cells("In thousands", "2024", "2023") + cells("Net cash", *[""] * 60, "7", "8") + "</table>"
    odd = "<table>" + cells("2024") + "<tr><td>lost<td>Revenue</td><td>1</td></tr><tr><td>Revenue</td><td>2</td><tr><td>capex</td><!-- <td>9</td> --><td>+3</td></tr></table>"
    told = "statutory_or_reported"
    assert table(spark, page, late, blank, odd, "", None, "<tr></tr>") == [
        (0, "adjusted_ebitda", 0, 12.5e6, "currency", 10**6, "GBP", 2024, "adjusted"),
        (0, "operating_margin", 0, 5.2, "percent", 1, None, 2024, told),
        (0, "revenue", 0, 1.2e9, "currency", 10**6, "GBP", 2024, told),
        (0, "revenue", 1, -30e6, "currency", 10**6, "GBP", 2023, told),
        (0, "revenue", 2, 5e6, "currency", 10**6, "GBP", None, told),
        (1, "cash_conversion", 0, 80.0, "percent", 1, None, 2021, told),
        (1, "net_debt", 0, 4.0, "currency", 1, "USD", None, told),
        (1, "net_debt", 1, 6.0, "currency", 1, "USD", 1999, told),
        (2, "net_cash", 0, 7000.0, "currency", 1000, None, 2024, told),
        (2, "net_cash", 1, 8000.0, "currency", 1000, None, 2023, told),
        (3, "capex", 0, 3.0, "currency", 1, None, 2024, told),
        (3, "revenue", 0, 1.0, "currency", 1, None, 2024, told),
    ]


def brute_excerpts(pages, terms, before, after, most):
    out = []
    for number, page in enumerate(pages or [], 1):
        text, held = " ".join((page or "").split()), []
        for term in terms:
            for m in re.finditer(re.escape(term), text, re.IGNORECASE):
                a, b = max(0, m.start() - before), min(len(text), m.end() + after)
                if len(out) < most and all(b < x or a > y for x, y in held):
                    held.append((a, b))
                    out.append((number, term, a, b, text[a:b]))
    return out


@pytest.mark.parametrize("before,after,most", [(180, 260, 8), (3, 5, 8), (0, 0, 1000), (10, 1, 0)])
def test_excerpts(spark, before, after, most):
    rng = random.Random(before)
    words = ["restructur", "Restructuring", "liquidity", "LIQUIDITY,", "covenant", "x" * 40, "the", "a.b", "a+b", "é 漢", "\n\n", "  "]
    rows = [(k, [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 4))]) for k in range(40)]
    rows += [(90, None), (91, []), (92, [None, "", "liquidity"]), (93, ["liquidity " * 20_000]), (94, ["aaaa"])]
    terms = ["restructur", "liquidity", "a.b", "a+b", "aa"]
    df = spark.createDataFrame([(*r, "n", "page") for r in rows], "id int, pages array<string>, start string, term string")
    got = figures.excerpts(df, F.col("pages"), ["id"], terms, before, after, most).collect()
    for k, pages in rows:
        mine = sorted((r for r in got if r.id == k), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(len(mine)))
        assert [(r.page, r.term, r.start, r.stop, r.excerpt) for r in mine] == brute_excerpts(pages, terms, before, after, most)
