"""Text, extraction and lifecycle queries on documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parse as pa
from tidemark.functions import text as tx
from tidemark.operators import extraction as ex
from tidemark.operators import figures as fg
from tidemark.plans.registry import query
from tidemark.streaming import lifecycle as lc

MARK = "regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g')"
SENTENCES = f"x as (select doc_id, list_filter(list_transform(string_split({MARK}, chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) between 20 and 1000) as s from documents)"


@query("""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<[^>]*\\bhidden\\b[^>]*>.*?</[^>]*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages""")
def visible_text(t):
    return t.pages.select("page_id", ex.visible_text(F.col("html")).alias("text"))


@query(f"with {SENTENCES}, e as (select doc_id, s, unnest(range(len(s))) as position from x) select doc_id, position::integer as position, s[position + 1] as sentence, array_to_string(s[greatest(position, 1):position + 2], ' ') as context from e")
def sentence_context(t):
    return ex.with_context(t.documents, "text", ["doc_id"])


RULES = {"licence": "licen[cs]ed?", "negative": r"\bno\b|\bnot\b|\bnon\b", "contact": r"\bcontact|example\.com", "article": r"\bthe of\b|\bde la\b|\bder die\b"}
# The oracle's word bounds are ASCII only, so its rules spell Unicode bounds out.
LEFT, RIGHT = r"(?:^|[^\pL\pN_])", r"(?:[^\pL\pN_]|$)"
BOUNDED = {"licence": RULES["licence"], "negative": f"{LEFT}(?:no|not|non){RIGHT}", "contact": f"{LEFT}contact|example\\.com", "article": f"{LEFT}(?:the of|de la|der die){RIGHT}"}


EACH_RULE = " union all ".join(f"select doc_id, position, '{k}' as rule, sentence, regexp_matches(sentence, '[0-9]') as quantified from y where regexp_matches(sentence, '(?i){p}')" for k, p in BOUNDED.items())


@query(f"with {SENTENCES}, e as (select doc_id, s, unnest(range(len(s))) as position from x), y as materialized (select doc_id, position::integer as position, s[position + 1] as sentence from e) {EACH_RULE}")
def lexicon_scan(t):
    return ex.scan(t.documents, "text", ["doc_id"], RULES)


EVENT_RULES = {"licence": "licen[cs]ed?", "token": "token|secret", "contact": r"@\w+"}
# The same bounds as the engine's, in which letters, decimal digits and marks of every script belong to a word.
START, END = r"(?:^|[^\pL\p{Mn}\p{Nd}_])", r"(?:[^\pL\p{Mn}\p{Nd}_]|$)"
EVENT_ROWS = ", ".join(f"('{k}', '(?i){p}')" for k, p in EVENT_RULES.items())


@query(f"""with {SENTENCES}, e as (select doc_id, s, unnest(range(len(s))) as position from x), r(event_type, p) as (values {EVENT_ROWS}), y as (select doc_id, position::integer as position, s[position + 1] as sentence from e),
h as (select *, regexp_extract(sentence, '(?s)^(.*?)(?:' || p || ')', 1) as head from y, r where regexp_matches(sentence, p)),
c as (select *, case when regexp_matches(right(head, 100), '(?i){START}(?:no|not|without|neither|nor){END}') then 'c' when regexp_matches(sentence, '(?i){START}(?:completed|previously announced|announced in 20\\d\\d|last year|prior year|following the){END}') then 'b' else 'a' end as st from h),
g as (select doc_id, event_type, lower(trim(regexp_replace(sentence, '\\s+', ' ', 'g'))) as k, min(position) as position, arg_min(sentence, position) as sentence, min(st) as st, bool_or(regexp_matches(sentence, '\\d')) as quantified from c group by all)
select doc_id, event_type, position, sentence, case st when 'a' then 'current_or_general' when 'b' then 'historical_or_completed' else 'negated' end as status, quantified from g""")
def lexicon_events(t):
    return ex.contextual_events(t.documents, "text", ["doc_id"], EVENT_RULES)


@query("""with l as (select doc_id, string_split(text, chr(10)) as l from documents), e as (select doc_id, l, unnest(range(len(l))) as i from l),
z as (select doc_id, (coalesce(list_sum(list_transform(l[1:i], lambda q: length(q) + 1)), 0))::integer as start, trim(l[i + 1], ' ') as zone, l[i + 1] as raw, row_number() over (partition by doc_id, l[i + 1] = '' order by i) - 1 as position from e),
r as (select *, regexp_matches(zone, '(?i)\\b(?:sales|revenue|volume|backlog|demand|margin|cost|restructur|severance|workforce|employee|appoint|facility|plant|site|capacity|production|supply|supplier|inventory|recall|quality|regulator|closure|opened|disruption|investment|charges?)\\b') as a,
 regexp_matches(zone, '(?i)(?:\\$|£|€|\\b\\d+(?:\\.\\d+)?%|\\b(?:increased|decreased|grew|declined|reduced)\\b)') as b from z where raw <> '')
select doc_id, position::integer as position, start, start + length(zone)::integer as stop, zone, array_to_string(list_filter([case when a then 'operational_language' end, case when b then 'quantitative_or_directional_change' end], lambda q: q is not null), ',') as reasons from r where zone <> '' and (a or b)""")
def zones(t):
    return ex.zones(t.documents, "text", ["doc_id"]).withColumn("reasons", F.array_join("reasons", ",")).select("doc_id", "position", "start", "stop", "zone", "reasons")


@query(f"""with {SENTENCES}, e as (select doc_id, unnest(s) as sentence from x), y as (select doc_id, regexp_matches(sentence, '(?i){LEFT}(?:may|might|could|potentially|risk of|possibility|if|should){RIGHT}') as hyp, regexp_matches(sentence, '(?i){LEFT}(?:no|not|without|neither|nor){RIGHT}') as neg from e)
select doc_id, count(*) as sentences, count(*) filter (hyp) as hypothetical, count(*) filter (neg) as negated from y group by 1""")
def sentence_flags(t):
    s = t.documents.select("doc_id", F.explode(ex.sentences(F.col("text"))).alias("s"))
    n = lambda p: F.count(F.when(F.col("s").rlike(p), 1))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), n(ex.HYPOTHETICAL).alias("hypothetical"), n(ex.NEGATION).alias("negated"))


@query()
def near_dup_events(t):
    e = ex.contextual_events(t.documents, "text", ["doc_id"], EVENT_RULES)
    return ex.near_duplicate_events(e, ["doc_id", "event_type"], "position", "sentence")


@query()
def near_dup_sources(t):
    """Sentences that repeat an earlier one of the same source and type, over all documents."""
    e = ex.contextual_events(t.documents.where("doc_id is not null"), "text", ["source", "doc_id"], EVENT_RULES)
    e = e.withColumn("place", F.col("doc_id") * (1 << 20) + F.col("position"))
    return ex.near_duplicate_events(e, ["source", "event_type"], "place", "sentence")


TERMS = ["license", "token", "@", "the", "de"]
PLACES = " union all ".join(f"select doc_id, page, text, {k} as t, '{x}' as term, string_split_regex(text, '(?i){x}') as parts from p" for k, x in enumerate(TERMS))


@query(f"""with recursive l as (select doc_id, string_split(text, chr(10)) as l from documents), q as (select doc_id, l, unnest(range(len(l))) as i from l),
p as (select doc_id, i + 1 as page, trim(regexp_replace(l[i + 1], '[\\s\\x0b\\x{{85}}\\pZ]+', ' ', 'g'), ' ') as text from q), s as ({PLACES}),
u as (select *, unnest(range(len(parts) - 1)) as j from s), a as (select doc_id, page, t, term, j, text, coalesce(list_sum(list_transform(parts[1:j + 1], lambda z: length(z))), 0)::bigint + j * length(term) as spot from u),
c as (select doc_id, row_number() over (partition by doc_id order by page, t, j) as r, {{'page': page::integer, 'term': term, 'start': greatest(spot - 180, 0)::integer, 'stop': least(spot + length(term) + 260, length(text))::integer}} as w from a),
f as (select doc_id, 0 as r, list_filter([w], lambda z: false) as taken from c where c.r = 1
union all select f.doc_id, c.r, case when len(taken) >= 8 or len(list_filter(taken, lambda z: z.page = c.w.page and not (c.w.stop < z.start or c.w.start > z.stop))) > 0 then taken else list_append(taken, c.w) end from f join c on c.doc_id = f.doc_id and c.r = f.r + 1),
g as (select doc_id, arg_max(taken, r) as taken from f group by 1), h as (select doc_id, unnest(range(len(taken)))::integer as n, unnest(taken) as w from g)
select h.doc_id, n, w.page, w.term, w.start, w.stop, substr(p.text, w.start + 1, w.stop - w.start) as excerpt from h join p on p.doc_id = h.doc_id and p.page = w.page""")
def excerpts(t):
    return fg.excerpts(t.documents, F.split("text", "\n"), ["doc_id"], TERMS)


@query("""select doc_id, sha256(source || '|' || lang || '|' || (strftime(date '2024-01-01' + (doc_id % 400)::integer, '%G')::integer)::varchar || '-' || (strftime(date '2024-01-01' + (doc_id % 400)::integer, '%V')::integer)::varchar || '|' ||
array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ')) as fingerprint from documents""")
def event_fingerprint(t):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    return t.documents.select("doc_id", tx.event_fingerprint(F.col("source"), F.col("lang"), day, F.col("text")).alias("fingerprint"))


@query("""with p as (select p_partkey, p_name || ' & Co, Group Holdings Ltd' as n from part)
select p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(n), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w not in ('plc', 'limited', 'ltd', 'holdings', 'group', 'the', '')), ' ') as name_a,
trim(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g'), '\\b(plc|limited|ltd|holdings|group|company|co|the)\\b', '', 'g')) as name_b, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') as name_key from p""")
def normalized_names(t):
    n = F.concat("p_name", F.lit(" & Co, Group Holdings Ltd"))
    return t.part.select("p_partkey", tx.normalize_name(n).alias("name_a"), tx.normalize_supplier(n).alias("name_b"), tx.normalize_key(n).alias("name_key"))


@query("""with a as (select b.item_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) as x, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) as y from benchmark b join documents d on d.doc_id = b.item_id)
select item_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::double, 9) as similarity from a""")
def token_jaccard(t):
    j = t.benchmark.select("item_id", F.col("text").alias("a")).join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("b")), "item_id")
    return j.select("item_id", F.round(tx.jaccard("a", "b"), 9).alias("similarity"))


@query("""select event_id, try_cast(nullif(regexp_extract(props, '(\\d+)', 1), '') as double) as number, lpad(user_id::varchar, 10, '0') as cik, case when event_type <> 'error' then 0 else least(24 * 2 ** least(greatest(event_id % 9 - 1, 0), 8), 168)::integer end as backoff from events""")
def scalar_functions(t):
    e = t.events
    return e.select("event_id", pa.percentage(F.concat(F.regexp_extract("props", r"(\d+)", 1), F.lit("%"))).alias("number"), pa.cik(F.col("user_id")).alias("cik"), pa.backoff_hours(F.col("event_id") % 9, F.col("event_type") != "error").alias("backoff"))


LIFE = """s as (select distinct user_id::varchar as source, event_type as identity, ts::date as ts from events), n as (select source, ts, row_number() over (partition by source order by ts) as i from (select distinct source, ts from s)),
a as (select s.source, identity, i, i - lag(i) over (partition by s.source, identity order by i) as gap from s join n using (source, ts)), l as (select source, max(i) as last from n group by 1),
p as (select source, identity, max(i) as m, count(*) filter (gap > 2) as reopened from a group by all)
select source, identity, case when last - m >= 2 then 'closed' else 'open' end as status, least(last - m, 2)::integer as misses, reopened::integer as reopened from p join l using (source)"""


def seen(t):
    return t.events.select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("identity"), F.to_date("ts").alias("ts"))


@query("with " + LIFE)
def lifecycle_closed_form(t):
    return lc.lifecycle_closed_form(seen(t), seen(t), ["source"], "identity")


@query("with " + LIFE)
def lifecycle_fold(t):
    s = seen(t).groupBy("source", "ts").agg(F.lit(True).alias("success"), F.collect_set("identity").alias("identities"))
    return lc.lifecycle_fold(s, ["source"])


@query("""with h as (select event_type as source, ts::date as ts, case when count(*) < 62 then 'fetch_failed' else 'healthy' end as health from events group by all), k as (select *, max(case when health = 'healthy' then ts end) over (partition by source) as ok from h),
p as (select source, max(ok) as last_success, max(ts) as latest, count(*) filter (ok is null or ts > ok)::integer as failures from k group by 1)
select source, last_success, failures, case when failures = 0 then 0 else least(24 * 2 ** least(failures - 1, 8), 168)::integer end as backoff_hours from p""")
def source_states(t):
    h = t.events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("ts")).agg(F.when(F.count(F.lit(1)) < 62, "fetch_failed").otherwise("healthy").alias("health"))
    return lc.source_states(h, ["source"]).select("source", "last_success", "failures", "backoff_hours")
