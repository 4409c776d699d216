"""Queries on filings that are written from the order tables: tagged facts and table figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import figures as fg
from tidemark.plans.registry import query

#: What a supplier ships in a year, in the order of years.
SHIPPED = "select l_suppkey, year(l_shipdate) as year, sum(l_quantity)::bigint as q from lineitem group by all"
SCALE = "case l_suppkey % 4 when 0 then 1000 when 1 then 1000000 when 2 then 1000000000 else 1 end"


@query(f"""with s as ({SHIPPED}), y as (select *, row_number() over (partition by l_suppkey order by year) - 1 as place, {SCALE} as scale, case l_suppkey % 3 when 0 then 'GBP' when 1 then 'USD' end as currency from s),
m as (select *, unnest(['revenue', 'net_debt', 'adjusted_operating_margin', 'adjusted_ebitda']) as metric from y)
select l_suppkey, metric, place::integer as place, (case metric when 'revenue' then q when 'net_debt' then -q when 'adjusted_ebitda' then q + 0.5 else q % 41 + 0.25 end)::double * case when metric = 'adjusted_operating_margin' then 1 else scale end as value,
case when metric = 'adjusted_operating_margin' then 'percent' else 'currency' end as unit, (case when metric = 'adjusted_operating_margin' then 1 else scale end)::bigint as scale, case when metric <> 'adjusted_operating_margin' then currency end as currency,
(case when place < 5 then year end)::integer as year, case when metric like 'adjusted%' then 'adjusted' else 'statutory_or_reported' end as basis from m""")
def table_figures(t):
    """A table for each supplier with a heading, blank cells before the figures, years for the first five of them."""
    k, q = F.col("l_suppkey"), F.format_number("q", 0)
    years = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").cast("long").alias("q"))
    sign = F.when(k % 3 == 0, "£").when(k % 3 == 1, "$").otherwise("")
    cell = F.struct(
        "year",
        F.concat(sign, q).alias("revenue"),
        F.concat(F.lit("("), q, F.lit(")")).alias("debt"),
        F.concat((F.col("q") % 41).cast("string"), F.lit(".25%")).alias("margin"),
        F.concat(q, F.lit("<b>.5</b>")).alias("ebitda"),
    )
    made = years.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    row = lambda label, name: F.concat(F.lit(f"<tr><td>{label}</td>"), F.repeat(F.lit("<td>&nbsp;</td>"), (k % 70).cast("int")), F.array_join(F.transform("c", lambda c: F.concat(F.lit("<td class='n'> "), c[name], F.lit("</td>"))), ""), F.lit("</tr>\n"))
    unit = F.when(k % 4 == 0, "in thousands").when(k % 4 == 1, "In Millions").when(k % 4 == 2, "in billions").otherwise("as told, millions apart")
    heads = F.array_join(F.transform(F.slice("c", 1, 5), lambda c: F.concat(F.lit("<th>Year "), c["year"].cast("string"), F.lit("</th>"))), "")
    html = F.concat(F.lit("<table><tr><th>Figures "), unit, F.lit("</th></tr><tr><td></td>"), heads, F.lit("</tr>"), row("Net sales", "revenue"), row("Net debt", "debt"), row("Adjusted operating margin", "margin"), row("<!-- x -->Adjusted<br> EBITDA", "ebitda"), row("Other", "debt"), F.lit("</table>"))
    return fg.table_figures(made.select("l_suppkey", html.alias("html")), "html", "l_suppkey").drop("evidence")


@query("""with y as (select o_custkey, year(o_orderdate) as year, count(*) as n, floor(sum(o_totalprice))::bigint as q from orders group by all), l as (select *, max(year) over (partition by o_custkey) as last from y), x as (select * from l where year = last)
select o_custkey, 'revenue' as metric, 'Revenues' as tag, q * 1000.0::double / 1000000 as value, 'GBP' as currency, 'million' as unit, 3 as scale, 1 as sign, year || '-01-01' as start_on, year || '-12-31' as end_on, 'current_fy' as role, 'statutory' as basis from x
union all select o_custkey, 'operating_profit', 'OperatingIncomeLoss', -n::double, null, 'pure', 0, -1, year || '-10-01', year || '-12-31', 'current_quarter', 'company_adjusted_or_custom' from x
union all select o_custkey, 'inventory', 'InventoryNet', -(n + 0.5)::double, null, 'shares', 0, -1, null, year || '-12-31', 'current_instant', 'statutory' from x""")
def tagged_facts(t):
    """A report for each customer, with contexts and facts of all its years, of which the last is the report's."""
    years = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("long").alias("q"))
    y, n = F.col("year").cast("string"), F.col("n").cast("string")
    period = lambda i, start, more="": F.concat(F.lit(f'<xbrli:context id="{i}'), y, F.lit(f'">{more}<xbrli:startDate>'), y, F.lit(f"-{start}</xbrli:startDate><xbrli:endDate>"), y, F.lit("-12-31</xbrli:endDate></xbrli:context>\n"))
    fact = lambda name, context, rest, value: F.concat(F.lit(f'<ix:nonFraction name="{name}" contextRef="{context}'), y, F.lit(f'" {rest}>'), value, F.lit("</ix:nonFraction>\n"))
    revenue = fact("us-gaap:Revenues", "fy", 'unitRef="money" scale="3"', F.format_number("q", 0))
    made = F.concat(
        period("fy", "01-01"),
        period("quarter", "10-01"),
        period("split", "01-01", "<xbrldi:explicitMember>part</xbrldi:explicitMember>"),
        F.concat(F.lit('<XBRLI:context id="now'), y, F.lit('"><xbrli:instant>'), y, F.lit("-12-31</xbrli:instant></XBRLI:context>")),
        revenue,
        fact("us-gaap:Revenues", "split", 'unitRef="money" scale="3"', n),
        revenue,
        fact("own:OperatingIncomeLoss", "quarter", "unitRef='times' sign='-'", F.concat(F.lit("<b>"), n, F.lit("</b>&nbsp;"))),
        fact("us-gaap:InventoryNet", "now", 'unitRef="parts"', F.concat(F.lit("("), n, F.lit(".5)"))),
        fact("us-gaap:Unknown", "fy", 'unitRef="money"', n),
        fact("us-gaap:Revenues", "quarter", 'unitRef="money"', F.lit("-")),
    )
    units = '<xbrli:unit id="money"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><xbrli:unit id="times"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit><xbrli:unit id="parts"><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>'
    reports = years.groupBy("o_custkey").agg(F.concat(F.lit(units), F.array_join(F.collect_list(made), "")).alias("html"), F.concat(F.max("year").cast("string"), F.lit("-12-31")).alias("ends"))
    return fg.ixbrl_facts(reports, "html", "o_custkey", "ends").drop("evidence", "context", "raw_value")
