"""Landed payloads of job boards, structured pages, notices and filings as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import strip_html

#: Columns of a posting, all strings but the time.
POSTING = ["external_id", "title", "department", "location", "description", "source_url", "posted_at"]


def _rows(df: DataFrame, payload: str, schema: str, array: str | None) -> DataFrame:
    parsed = df.withColumn("_p", F.from_json(payload, schema))
    return parsed.select(*[c for c in df.columns if c != payload], F.explode(F.col("_p") if array is None else F.col(f"_p.{array}")).alias("j"))


def _posting(df: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    posted = F.try_to_timestamp(F.regexp_replace(columns.pop("posted_at"), "Z$", "+00:00"))
    return df.select(*keys, *(columns.get(c, F.lit(None)).cast("string").alias(c) for c in POSTING[:-1]), posted.alias("posted_at"))


def greenhouse(df: DataFrame, payload: str = "payload") -> DataFrame:
    """jobs[] with department names joined and the content as plain text (A5)."""
    keys = [c for c in df.columns if c != payload]
    j = _rows(df, payload, "jobs array<struct<id:string,title:string,absolute_url:string,updated_at:string,content:string,location:struct<name:string>,departments:array<struct<name:string>>>>", "jobs")
    return _posting(j, keys, external_id=F.col("j.id"), title=F.col("j.title"), department=F.nullif(F.array_join(F.transform("j.departments", lambda d: d["name"]), ", "), F.lit("")), location=F.col("j.location.name"), description=strip_html(F.col("j.content")), source_url=F.col("j.absolute_url"), posted_at=F.col("j.updated_at"))


def lever(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A top-level array; the plain description, else the other as plain text."""
    keys = [c for c in df.columns if c != payload]
    j = _rows(df, payload, "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,description:string,categories:struct<team:string,location:string>>>", None)
    at = F.date_format(F.timestamp_millis(F.col("j.createdAt")), "yyyy-MM-dd'T'HH:mm:ss")
    return _posting(j, keys, external_id=F.col("j.id"), title=F.col("j.text"), department=F.col("j.categories.team"), location=F.col("j.categories.location"), description=F.coalesce(F.nullif(F.trim("j.descriptionPlain"), F.lit("")), strip_html(F.col("j.description"))), source_url=F.col("j.hostedUrl"), posted_at=at)


def ashby(df: DataFrame, payload: str = "payload") -> DataFrame:
    """jobs[]; the id falls back to the last segment of the address."""
    keys = [c for c in df.columns if c != payload]
    j = _rows(df, payload, "jobs array<struct<id:string,title:string,department:string,location:string,jobUrl:string,publishedAt:string,descriptionPlain:string>>", "jobs")
    last = F.element_at(F.split(F.regexp_replace("j.jobUrl", "/+$", ""), "/"), -1)
    return _posting(j, keys, external_id=F.coalesce("j.id", last), title=F.col("j.title"), department=F.col("j.department"), location=F.col("j.location"), description=F.col("j.descriptionPlain"), source_url=F.col("j.jobUrl"), posted_at=F.col("j.publishedAt"))


def smartrecruiters(df: DataFrame, payload: str = "payload") -> DataFrame:
    """content[] with nested labels."""
    keys = [c for c in df.columns if c != payload]
    j = _rows(df, payload, "content array<struct<id:string,name:string,ref:string,releasedDate:string,department:struct<label:string>,location:struct<city:string,region:string,country:string>>>", "content")
    return _posting(j, keys, external_id=F.col("j.id"), title=F.col("j.name"), department=F.col("j.department.label"), location=F.nullif(F.concat_ws(", ", "j.location.city", "j.location.region", "j.location.country"), F.lit("")), source_url=F.col("j.ref"), posted_at=F.col("j.releasedDate"))


def recruitee(df: DataFrame, payload: str = "payload") -> DataFrame:
    """offers[] (A9)."""
    keys = [c for c in df.columns if c != payload]
    j = _rows(df, payload, "offers array<struct<id:string,title:string,department:string,location:string,careers_url:string,published_at:string,description:string>>", "offers")
    return _posting(j, keys, external_id=F.col("j.id"), title=F.col("j.title"), department=F.col("j.department"), location=F.col("j.location"), description=strip_html(F.col("j.description")), source_url=F.col("j.careers_url"), posted_at=F.col("j.published_at"))


PROVIDERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters, "recruitee": recruitee}


def union_feeds(df: DataFrame, provider: str = "provider", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Postings of all known providers under one schema, and the rows of unknown ones (A10)."""
    out = None
    for name, f in PROVIDERS.items():
        part = f(df.where(F.col(provider) == name), payload)
        out = part if out is None else out.unionByName(part)
    return out, df.where(~F.coalesce(F.col(provider).isin(*PROVIDERS), F.lit(False)))


# Hosts of job boards in order: how the host is compared, with what; provider; where its identifier
# stands; whether it has a public interface; a note.
BOARDS = [
    ("is", "boards.greenhouse.io", "greenhouse", "path", True, "Documented public GET API"),
    ("is", "job-boards.greenhouse.io", "greenhouse", "path", True, "Documented public GET API"),
    ("is", "jobs.lever.co", "lever", "path", True, "Documented public postings API"),
    ("is", "jobs.eu.lever.co", "lever-eu", "path", True, "Documented public postings API"),
    ("is", "jobs.ashbyhq.com", "ashby", "path", True, "Documented public job-board API"),
    ("is", "jobs.smartrecruiters.com", "smartrecruiters", "path", True, "Public Posting API"),
    ("ends", ".recruitee.com", "recruitee", "rest", True, "Public careers-site feed"),
    ("has", "myworkdayjobs.com", "workday", "label", False, "No general documented public job-board API"),
    ("is", "apply.workable.com", "workable", "path", False, "Formal API requires customer credentials"),
    ("ends", ".workable.com", "workable", None, False, "Formal API requires customer credentials"),
    ("ends", ".teamtailor.com", "teamtailor", "rest", False, "Public API requires an API key"),
    ("has", "icims.com", "icims", None, False, "Use public-page structured data where permitted"),
    ("has", "personio.", "personio", "label", False, "Use public XML/page feed only when exposed by the employer"),
    ("has", "successfactors", "successfactors", None, False, "Enterprise API is authenticated"),
    ("has", "taleo.net", "taleo", None, False, "Use public-page structured data where permitted"),
]
OTHER_BOARD = "Inspect for schema.org JobPosting data"


def detect_provider(url: Column) -> Column:
    """provider, identifier, public_api and note of a careers address, by its host."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/+([^/]+)", 1), F.lit(""))
    row = lambda p, i, open_, note: F.struct(F.lit(p).alias("provider"), i.alias("identifier"), F.lit(open_).alias("public_api"), F.lit(note).alias("note"))
    none = F.lit(None).cast("string")
    out = row("unknown", none, False, OTHER_BOARD)
    for kind, text, provider, place, open_, note in reversed(BOARDS):
        test = {"is": host == text, "ends": host.endswith(text), "has": host.contains(text)}[kind]
        name = {"path": path, "rest": F.substring(host, F.lit(1), F.length(host) - len(text)), "label": F.regexp_extract(host, r"^([^.]*)", 1), None: none}[place]
        out = F.when(test, row(provider, name, open_, note)).otherwise(out)
    return out


def jsonld_jobs(df: DataFrame, html: str, keys: Sequence[str]) -> DataFrame:
    """keys, n, job VARIANT: JobPosting objects of JSON-LD scripts: at the top, in a list, in @graph or its lists.

    Scripts that are no JSON are passed over.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    parsed = df.select(*keys, F.posexplode(blocks).alias("b", "s")).select(*keys, "b", F.try_parse_json("s").alias("v")).where("v is not null")
    arr = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    level = parsed.select(*keys, "b", F.explode(F.concat(F.array("v"), arr("v", "$"), arr("v", "$['@graph']"))).alias("v"))
    level = level.select(*keys, "b", F.explode(F.concat(F.array("v"), arr("v", "$"), arr("v", "$['@graph']"))).alias("v"))
    one = F.try_variant_get("v", "$['@type']", "string")
    many = F.coalesce(F.array_contains(F.try_variant_get("v", "$['@type']", "array<string>"), "JobPosting"), F.lit(False))
    found = level.where((F.coalesce(one, F.lit("")) == "JobPosting") | many).withColumn("_j", F.to_json("v")).dropDuplicates([*keys, "b", "_j"])
    return found.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("b", "_j"))).select(*keys, "n", F.col("v").alias("job"))


def jsonld_postings(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Postings of JobPosting objects: identifier value or name, location joined, synthetic id, default title."""
    g = lambda p: F.try_variant_get("job", p, "string")
    place = F.nullif(F.concat_ws(", ", *(F.coalesce(g(f"$.jobLocation.address.{k}"), g(f"$.jobLocation[0].address.{k}")) for k in ("addressLocality", "addressRegion", "addressCountry"))), F.lit(""))
    synthetic = F.concat(F.lit("jsonld-"), F.col("n").cast("string"), F.lit("-"), F.substring(F.sha2(F.to_json("job"), 256), 1, 12))
    scalar = F.when(~F.coalesce(g("$.identifier"), F.lit("{")).startswith("{"), g("$.identifier"))
    return jobs.select(*keys, F.coalesce(g("$.identifier.value"), g("$.identifier.name"), scalar, synthetic).alias("external_id"), F.coalesce(g("$.title"), F.lit("Untitled role")).alias("title"), place.alias("location"), strip_html(g("$.description")).alias("description"), F.coalesce(g("$.url"), F.lit(None)).alias("source_url"))


NOTICE = "releases array<struct<ocid:string,date:string,tender:struct<title:string,value:struct<amount:double,currency:string>>,parties:array<struct<id:string,name:string>>,awards:array<struct<id:string,value:struct<amount:double,currency:string>,suppliers:array<struct<id:string,name:string>>>>>>"


def flatten_notices(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per release, award (or none) and supplier (or none) with value and hash.

    A supplier's name is the award's, else the party's of the same id; a value is the award's, else the
    tender's. Parties are looked up inside the row, so nothing is shuffled.
    """
    keys = [c for c in df.columns if c != payload]
    r = _rows(df, payload, NOTICE, "releases")
    a = r.select(*keys, "j", F.explode_outer("j.awards").alias("a"))
    s = a.select(*keys, "j", "a", F.explode_outer("a.suppliers").alias("s"))
    party = F.get(F.transform(F.filter("j.parties", lambda p: p["id"] == F.col("s.id")), lambda p: p["name"]), F.lit(0))
    out = s.select(*keys, F.col("j.ocid").alias("ocid"), F.col("j.date").alias("published"), F.col("j.tender.title").alias("title"), F.col("a.id").alias("award_id"), F.col("s.id").alias("supplier_id"), F.coalesce("s.name", party).alias("supplier"), F.coalesce("a.value.amount", "j.tender.value.amount").alias("amount"), F.coalesce("a.value.currency", "j.tender.value.currency").alias("currency"))
    return out.withColumn("row_hash", F.sha2(F.to_json(F.struct("ocid", "published", "title", "award_id", "supplier_id", "supplier", "amount", "currency")), 256))


FILINGS = "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,primaryDocument:array<string>>"


def select_filings(df: DataFrame, key: str, quotas: dict[str, int], until: str, payload: str = "payload") -> DataFrame:
    """The newest filings up to a date, as many of each form as its quota, from parallel arrays."""
    p = df.select(key, F.from_json(payload, FILINGS).alias("p"))
    each = p.select(key, F.posexplode(F.arrays_zip("p.form", "p.filingDate", "p.accessionNumber", "p.primaryDocument")).alias("i", "f")).select(key, "i", "f.*")
    quota = F.try_element_at(F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v)))), F.col("form"))
    place = F.row_number().over(Window.partitionBy(key, "form").orderBy("i"))
    return each.where(F.col("filingDate") <= until).withColumn("place", place).where(F.col("place") <= quota)
