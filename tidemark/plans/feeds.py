"""Queries of the readers, writers and landed payloads: the tables are put into a source's form and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.documents import LIFE, seen
from tidemark.plans.registry import query
from tidemark.sources import postings as po
from tidemark.sources import tables as st
from tidemark.sources.scratch import place


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority || ', \"' || o_orderstatus || '\"' || chr(10) as note, cast(o_totalprice as double) as o_totalprice from orders")
def csv_round_trip(t):
    note = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"\n'))
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", note.alias("note"), F.col("o_totalprice").cast("double").alias("o_totalprice"))
    folder = place(t.spark)
    st.write_csv(rows, folder, rows.columns)
    return st.read_csv(t.spark, folder, rows.schema)


@query("select doc_id, md5(nullif(text, '')) as text_md5, length(nullif(text, '')) as n, nullif(lang, '') as lang, nullif(source, '') as source from documents")
def csv_texts(t):
    rows, folder = t.documents.select("doc_id", "text", "lang", "source"), place(t.spark)
    st.write_csv(rows, folder, rows.columns)
    texts = st.read_csv(t.spark, folder, rows.schema)
    return texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n"), "lang", "source")


@query("select conv_id, turn, role, md5(text) as text_md5 from conversations")
def jsonl_round_trip(t):
    rows, folder = t.conversations.select("conv_id", "turn", "role", "text"), place(t.spark)
    st.write_jsonl(rows, folder)
    return st.read_jsonl(t.spark, folder, rows.schema).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("select l_orderkey, l_suppkey, count(*) as n from lineitem group by all having count(*) > 1")
def batch_repeats(t):
    rows, folder = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber"), place(t.spark)
    for odd in (0, 1):
        st.write_csv(rows.where(F.col("l_linenumber") % 2 == odd), f"{folder}/batch{odd}", rows.columns)
    return st.read_batches(t.spark, f"{folder}/batch*", rows.schema, ["l_orderkey", "l_suppkey"])[1].select("l_orderkey", "l_suppkey", "n")


FEEDS = ["greenhouse", "lever", "ashby", "smartrecruiters", "recruitee", "elsewhere"]
FEED = "(['" + "', '".join(FEEDS) + "'])[o_custkey % 6 + 1]"


def _payloads(t):
    """A payload for each customer, whose orders are the jobs of a board."""
    key, status, urgency = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    url, at = F.concat(F.lit("https://jobs.example.com/co/"), key), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    html = F.concat(F.lit("<p>"), status, F.lit(" <b>"), urgency, F.lit("</b></p>"))
    s = lambda **columns: F.struct(*(c.alias(n) for n, c in columns.items()))
    jobs = {
        "greenhouse": ("jobs", s(id=key, title=urgency, absolute_url=url, updated_at=at, content=html, location=s(name=status), departments=F.array(s(name=urgency), s(name=status)))),
        "lever": (None, s(id=key, text=urgency, hostedUrl=url, createdAt=F.unix_millis(F.col("o_orderdate").cast("timestamp")), description=html, categories=s(team=status, location=urgency))),
        "ashby": ("jobs", s(title=urgency, department=status, location=status, jobUrl=F.concat(url, F.lit("/")), publishedAt=at, descriptionPlain=urgency)),
        "smartrecruiters": ("content", s(id=key, name=urgency, ref=url, releasedDate=at, department=s(label=status), location=s(city=status, country=urgency))),
        "recruitee": ("offers", s(id=key, title=urgency, department=status, location=status, careers_url=url, published_at=at, description=html)),
    }
    out = F.lit("{}")
    for name, (array, job) in jobs.items():
        rows = F.collect_list(F.when(F.col("provider") == name, job))
        out = F.when(F.first("provider") == name, F.to_json(rows if array is None else F.struct(rows.alias(array)))).otherwise(out)
    provider = F.element_at(F.array(*map(F.lit, FEEDS)), (F.col("o_custkey") % 6 + 1).cast("int"))
    return t.orders.withColumn("provider", provider).groupBy(F.col("o_custkey").alias("company"), "provider").agg(out.alias("payload"))


JOB = "o_custkey as company, o_orderkey::varchar as id, o_orderpriority as u, o_orderstatus as st, 'https://jobs.example.com/co/' || o_orderkey as url, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as posted"


@query(f"""with j as (select {JOB}, {FEED} as f from orders)
select company, id as external_id, u as title, case f when 'greenhouse' then u || ', ' || st else st end as department,
 case f when 'lever' then u when 'smartrecruiters' then st || ', ' || u else st end as location,
 case when f in ('greenhouse', 'lever', 'recruitee') then st || ' ' || u when f = 'ashby' then u end as description, case f when 'ashby' then url || '/' else url end as source_url, posted as posted_at
from j where f <> 'elsewhere'""")
def board_feeds(t):
    found, _ = po.union_feeds(_payloads(t))
    text = F.trim(F.regexp_replace("description", r"\s+", " "))
    return found.select("company", "external_id", "title", "department", "location", text.alias("description"), "source_url", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


@query(f"select distinct o_custkey as company, {FEED} as provider from orders where {FEED} = 'elsewhere'")
def unknown_feeds(t):
    return po.union_feeds(_payloads(t))[1].select("company", "provider")


@query("""select page_id, case page_id % 3 when 0 then 'v' when 1 then 'n' else 's' end || page_id as external_id, case when page_id % 4 = 0 then 'Untitled role' else url end as title,
 'L' || page_id || case when page_id % 5 = 0 then '' else ', GB' end as location, url as source_url from pages""")
def page_jobs(t):
    k = F.col("page_id")
    text = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    number = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit('{"value":"v'), number, F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit('{"name":"n'), number, F.lit('"}'))).otherwise(F.concat(F.lit('"s'), number, F.lit('"')))
    title = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(',"title":'), text(F.col("url"))))
    address = F.concat(F.lit('{"address":{"addressLocality":"L'), number, F.when(k % 5 == 0, F.lit('"}}')).otherwise(F.lit('","addressCountry":"GB"}}')))
    where = F.when(k % 2 == 0, address).otherwise(F.concat(F.lit("["), address, F.lit("]")))
    job = F.concat(F.lit('{"@type":"JobPosting","identifier":'), name, title, F.lit(',"url":'), text(F.col("url")), F.lit(',"jobLocation":'), where, F.lit("}"))
    held = F.when(k % 7 == 0, F.concat(F.lit('{"@graph":['), job, F.lit(',{"@type":"Organization"}]}'))).when(k % 7 == 1, F.concat(F.lit("["), job, F.lit("]"))).otherwise(job)
    page = F.concat(F.coalesce("html", F.lit("")), F.lit('<script type="application/ld+json">'), held, F.lit("</script>"))
    jobs = po.jsonld_jobs(t.pages.select("page_id", page.alias("html")), "html", ["page_id"])
    return po.jsonld_postings(jobs, ["page_id"]).select("page_id", "external_id", "title", "location", "source_url")


@query("""select o_orderkey, o_orderkey::varchar as ocid, strftime(o_orderdate, '%Y-%m-%d') as published, o_orderpriority as title, l_linenumber::varchar as award_id, l_suppkey::varchar as supplier_id,
 case when l_suppkey % 2 = 0 then 'S' || l_suppkey when l_suppkey % 3 > 0 then 'P' || l_suppkey end as supplier,
 (case when l_linenumber % 2 = 0 then l_extendedprice else o_totalprice end)::double as amount, case when l_linenumber % 2 = 0 then 'EUR' else 'USD' end as currency from orders left join lineitem on l_orderkey = o_orderkey""")
def notice_awards(t):
    key = F.col("l_suppkey").cast("string")
    money = lambda amount, currency: F.struct(F.col(amount).cast("double").alias("amount"), F.lit(currency).alias("currency"))
    supplier = F.struct(key.alias("id"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("S"), key)).alias("name"))
    award = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, money("l_extendedprice", "EUR")).alias("value"), F.array(supplier).alias("suppliers"))
    party = F.when(F.col("l_suppkey") % 3 > 0, F.struct(key.alias("id"), F.concat(F.lit("P"), key).alias("name")))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(award).alias("awards"), F.collect_set(party).alias("parties"))
    tender = F.struct(F.col("o_orderpriority").alias("title"), money("o_totalprice", "USD").alias("value"))
    release = F.struct(F.col("o_orderkey").cast("string").alias("ocid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), tender.alias("tender"), "parties", "awards")
    payloads = t.orders.join(lines, "o_orderkey", "left").select("o_orderkey", F.to_json(F.struct(F.array(release).alias("releases"))).alias("payload"))
    return po.flatten_notices(payloads).drop("row_hash")


@query("""with f as (select o_custkey, o_orderstatus as form, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey from orders), r as (select *, row_number() over (partition by o_custkey, form order by day desc, o_orderkey desc) as place from f where day <= '1996-12-31')
select o_custkey, form, day, o_orderkey::varchar as accession, place::integer as place from r where place <= case form when 'F' then 3 when 'O' then 1 end""")
def selected_filings(t):
    filing = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(filing), asc=False).alias("f"))
    part = lambda name: F.transform("f", lambda x: x[name].cast("string"))
    payload = F.to_json(F.struct(part("o_orderstatus").alias("form"), part("day").alias("filingDate"), part("o_orderkey").alias("accessionNumber"), part("o_orderpriority").alias("primaryDocument")))
    found = po.select_filings(rows.select("o_custkey", payload.alias("payload")), "o_custkey", {"F": 3, "O": 1}, "1996-12-31")
    return found.select("o_custkey", "form", F.col("filingDate").alias("day"), F.col("accessionNumber").alias("accession"), "place")


@query("with " + LIFE)
def replayed_states(t):
    """The store is first given another state, so that what is read is the rebuilt one."""
    store = place(t.spark)
    st.publish(t.events.select("event_id"), store)
    snapshots = seen(t).groupBy("source", "ts").agg(F.lit(True).alias("success"), F.collect_set("identity").alias("identities"))
    return st.replay(snapshots, ["source"], store)
