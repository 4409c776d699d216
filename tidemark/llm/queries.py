"""Registered queries of the corpus operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import place

    return place(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "slot", "shard")


def op6_sql() -> str:
    """Placement in SQL; the table itself is tested against its definition."""
    from tidemark.llm import sharding as sh

    shards = sh.lookup_table(sh.names())
    return f"""
with t as (select {shards} as shards), k as (select doc_id, (('0x' || substr(sha256(coalesce(doc_id::varchar, text, '')), 1, 8))::bigint % {sh.SLOTS})::integer as slot from documents)
select doc_id, slot, printf('shard-%05d', shards[slot + 1]) as shard from k, t
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import rules

    return rules(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffixes import removal

    return removal(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.byte_bpe import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.trie import trie_digest

    return trie_digest(table(spark, sf_dir, "conversations"))


OP3_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
    where q.vec_id % 50 = 0
), r as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op2_sql() -> str:
    """The quality rules in SQL, from the same fixed values."""
    from tidemark.llm import quality as q

    word_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    commons = " ".join(f"when '{k}' then {word_list(v)}" for k, v in q.COMMON.items() if k)
    strips, left = [], "body"
    for k, pattern in enumerate(q.CLASSES.values()):
        strips.append(f"s{k} as (select *, regexp_replace({left}, '{pattern}', '', 'g') as left{k} from {'base' if k == 0 else f's{k - 1}'})")
        left = f"left{k}"
    n = len(q.CLASSES)
    sizes = ", ".join(["length(body) - length(left0)", *(f"length(left{k - 1}) - length(left{k})" for k in range(1, n)), f"length(left{n - 1})"])
    wide = len(q.COMMON["en"]) + 1
    sums = lambda c, m: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(m)) + "]"

    def distance(a: str, b: str) -> str:
        share = lambda x: f"list_transform({x}, lambda v: v / nullif(list_sum({x}), 0)::double)"
        part = "case when z[{0}] > 0 then z[{0}] * log2(z[{0}] / ((z[1] + z[2]) / 2)) else 0.0 end"
        return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({share(a)}, {share(b)}), lambda z: ({part.format(1)} + {part.format(2)}) / 2))))"

    return f"""
with base as (
    select row_number() over () as row_id, doc_id, coalesce(text, '') as body,
        case when lang in ({", ".join(f"'{k}'" for k in q.COMMON)}) then lang else '' end as grp,
        list_filter(string_split_regex(coalesce(text, ''), '{q.BLANKS}'), lambda x: x <> '') as words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
    from documents
), {", ".join(strips)}, counted as (
    select *, [{sizes}] as cls, len(words) as n_words,
        case grp {commons} else {word_list(q.COMMON[""])} end as common
    from s{n - 1}
), more as (
    select *, list_concat(list_transform(common, lambda w: len(list_filter(words, lambda x: x = w))), [len(list_filter(words, lambda x: not list_contains(common, x)))]) as com
    from counted
), refs as (
    select grp, sum(n_words) as r_words, {sums("cls", n + 1)} as r_cls, {sums("com", wide)} as r_com from more where n_words >= {q.LEAST_WORDS} group by grp
), grams as (
    select row_id, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as gram
    from (select row_id, words, unnest(range(1, len(words) - 1)) as p from base)
), twice as (
    select row_id, p from (select row_id, p, count(*) over (partition by row_id, gram) as c from grams) where c > 1
), covered as (
    select row_id, count(*) as n from (select distinct row_id, p + d as w from twice, (values (0), (1), (2)) as t(d)) group by row_id
), judged as (
    select m.doc_id, m.n_words, length(m.body) - m.cls[2] as word_chars, length(m.body) - length(regexp_replace(m.body, '{q.SYMBOLS}', '', 'g')) as n_symbols,
        len(m.lines) - len(list_distinct(m.lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, r.r_words,
        {distance("m.cls", "r.r_cls")} as far_cls, {distance("m.com", "r.r_com")} as far_com
    from more m left join covered c using (row_id) left join refs r on r.grp = m.grp
), failed as (select *, n_words < {q.LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from judged)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
    not base_failed and not coalesce(r_words >= {q.GUARD_REFERENCE} and (n_words >= {q.GUARD_CLASS} and far_cls > {q.MOST_CLASS} or n_words >= {q.GUARD_COMMON} and far_com > {q.MOST_COMMON}), false) as kept
from failed
"""


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_sql() -> str:
    """License scans in SQL: all k-grams joined to all templates, and every diagonal with its neighbours."""
    from tidemark.llm import licenses as li

    rows = ", ".join(f"({t}, '{label}', {str(base).lower()}, {len(words)}, {0 if base else -(-len(words) // li.SPREAD)}, {1.0 if base or len(words) <= li.SHORT else li.LEAST_COVER}, '{' '.join(words)}')" for t, (label, base, words) in enumerate(li.templates()))
    return f"""
with t(t, label, base, n, reach, least, phrase) as (values {rows}),
tg as (select t, label, base, n - 2 as grams, reach, least, i as tpos, list_aggregate(string_split(phrase, ' ')[i + 1:i + 3], 'string_agg', ' ') as gram from (select *, unnest(range(n - 2)) as i from t)),
w as (select row_number() over () as rid, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
g as (select rid, i as pos, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] as gram from (select rid, words, unnest(range(len(words) - 2)) as i from w)),
h as materialized (select rid, t, label, base, grams, reach, least, pos - tpos as d, tpos, pos from g join tg using (gram)),
c as (select distinct rid, t, d, reach from h),
v as (select h.rid, h.t, label, base, c.d, min(pos) as start, max(pos) + 3 as stop, any_value(grams) as grams, count(distinct tpos) / any_value(grams)::double as cover, any_value(least) as least from c join h on h.rid = c.rid and h.t = c.t and abs(h.d - c.d) <= c.reach group by h.rid, h.t, label, base, c.d),
a as (select * from v where cover >= least),
p as (select * from a where base or not exists (select 1 from a as o where o.rid = a.rid and not o.base and o.label <> a.label and 2 * (least(a.stop, o.stop) - greatest(a.start, o.start)) > a.stop - a.start and (o.cover > a.cover or o.cover = a.cover and o.grams > a.grams)))
select any_value(w.doc_id) as doc_id, any_value(len(words))::bigint as n_words, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
    coalesce(array_to_string(list_sort(list(distinct label) filter (base)), ','), '') as base_labels, coalesce(array_to_string(list_sort(list(distinct label) filter (label is not null)), ','), '') as labels, coalesce(max(cover), 0.0)::double as score
from w left join p using (rid) group by rid
"""


OP4_SQL = """
with b as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
q as (select rid, 256 * j as base, substr(x, 512 * j + 1, 910) as y, least(256, n - 199 - 256 * j) as many from (select rid, x, n, unnest(range((n + 56) // 256)) as j from b where n >= 200)),
g as (select rid, base + i as i, md5_number(substr(y, 2 * i + 1, 400)) as m from (select rid, base, y, unnest(range(many)) as i from q)),
r as (select rid, i from g where m in (select m from g group by m having count(*) > 1)),
s as (select rid, i, sum(case when i - before <= 200 then 0 else 1 end) over (partition by rid order by i) as run from (select *, lag(i) over (partition by rid order by i) as before from r)),
u as (select rid, run, min(i) as low, max(i) + 200 as high from s group by all),
k as (select rid, run, low, high, coalesce(lag(high) over (partition by rid order by run), 0) as since from u),
l as (select k.rid, sum(high - low) as removed, count(*) as spans, string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' order by run) as head, max(high) as last from k join b using (rid) group by 1)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256 from b left join l using (rid)
"""

OP8_SQL = f"""
with recursive w as (select doc_id, list_filter(string_split_regex({LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then '<' || array_to_string(w, ' ') else w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] end as g from (select doc_id, w, unnest(range(greatest(len(w) - 2, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
t as (select s.doc_id, g, n from s join n using (doc_id)),
e as materialized (select a.doc_id as a, b.doc_id as b from t a join t b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ as (select a, b from e union all select b, a from e),
r(a, b) as (select doc_id, doc_id from documents union select r.a, x.b from r join both_ x on x.a = r.b)
select r.a as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.b) as component_id, r.a = min(r.b) as kept from r left join n on n.doc_id = r.a group by r.a
"""

#: crc32 by bytes: a table of 256 remainders, and a fold over the UTF-8 bytes of w.
CRC_TABLE = "select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t"
CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"

OP12_SQL = f"""
with crc as ({CRC_TABLE}),
d as (select row_number() over () as rid, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
f as (select rid, unnest(words) as w from d),
g as (select unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
b as materialized (select w, {CRC} % 10000 as bucket from (select w from f union select w from g) as x, crc),
s as (select bucket, count(*) as s from f join b using (w) group by bucket),
t as (select bucket, count(*) as t from g join b using (w) group by bucket),
n as (select (select count(*) from f) as every, (select count(*) from g) as aimed),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (every + 10000)::double / ((coalesce(s, 0) + 1)::double * (aimed + 10000)::double)))::bigint as gain from s full join t using (bucket), n),
w as (select rid, count(*) as n_features, floor(sum(gain) / count(*)::double)::bigint as weight from f join b using (w) join gain using (bucket) group by rid),
v as (select d.rid, doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from d left join w using (rid)),
r as (select rid, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as r, count(*) over () as n from v where n_features >= 20)
select doc_id, n_features, weight, score, case when r <= 10 * n // 100 then r end as rank from v left join r using (rid)
"""

OP13_SQL = f"""
with crc as ({CRC_TABLE}),
own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, n, conv_id - conv_id % 5 as base, {CRC} % 9 as h from (select conv_id, conv_id::varchar as w, count(*) as n from own group by 1) as x, crc),
m as (select c.*, least(c.h, coalesce(b.n, 0)) as head from c left join c as b on b.conv_id = c.base),
turns as (
    select m.conv_id, i as pos, role, text from m join own on own.conv_id = m.base where i <= h
    union all select m.conv_id, i - h + head, role, text from m join own using (conv_id) where i > h
),
paths as (
    select conv_id, pos, strlen(text) as bytes, md5(string_agg(sha256(role) || sha256(text), '' order by pos) over (partition by conv_id order by pos)) as node from turns
    union all select conv_id, 0, 0, '' from c
),
steps as (select *, lag(node) over (partition by conv_id order by pos) as up, lead(pos) over (partition by conv_id order by pos) is null as is_last from paths),
nodes as (select pos, node, any_value(up) as up, any_value(bytes) as bytes, min(conv_id) as conv_id, count(*) as n, string_agg(conv_id::varchar, ',' order by conv_id) filter (is_last) as ends from steps group by pos, node),
kids as (select up, pos - 1 as pos, count(*) as n_children from nodes where pos > 0 group by all),
under as (select distinct a.pos, a.node, b.pos as low_pos, b.node as low from steps a join steps b on a.conv_id = b.conv_id and b.pos >= a.pos),
sums as (
    select u.pos, u.node, sum((x.n - 1) * x.bytes)::bigint as saved_tokens, count(*) filter (k.n_children is null) as n_leaves
    from under u join nodes x on x.pos = u.low_pos and x.node = u.low left join kids k on k.pos = u.low_pos and k.up = u.low group by u.pos, u.node
)
select a.conv_id, a.pos::bigint as depth, p.conv_id as parent_conv_id, a.n as n_convs, coalesce(k.n_children, 0)::bigint as n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(a.ends, '')) as ends_sha256
from nodes a join sums s on s.pos = a.pos and s.node = a.node left join kids k on k.pos = a.pos and k.up = a.node left join nodes p on p.pos = a.pos - 1 and p.node = a.up
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_licenses, op2_quality, op3_topk, op4_suffixes, op5_packing, op6_sharding, op7_language, op8_neardup, op9_html, op10_bpe, op11_bytebpe, op12_importance, op13_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": op1_sql(), "op2_quality": op2_sql(), "op3_topk": OP3_SQL, "op4_suffixes": OP4_SQL, "op6_sharding": op6_sql(), "op8_neardup": OP8_SQL, "op12_importance": OP12_SQL, "op13_trie": OP13_SQL}
