"""The corpus operators against brute force, the library, or the truth; nulls, empty and long texts, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, difference_cover, html, language, licenses, neardup, packing, quality, queries, sharding, suffixes, topk

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, place string, score double, words string, tokens string"


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def odd_texts():
    rng = random.Random(5)
    letters = list("abc é漢😀ΣİK'\n\t 12#|<>") + ["<|endoftext|>", "'s", " the ", "  ", "cc by nc ", "apache license version 2 "]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    long = "under the mit license " + "word " * 3000 + "under the MIT license"
    base = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(120))
    return [None, "", " ", "\n\n", "a", "A a A a A a", long, base, base, base + " end", "x" + base, "a" * 1000, *made]


def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None, "r", "n", "p", 0.5, "w", "t") for i, t in enumerate(odd_texts())]
    rows += [(3, "twice the same row", "en", "s", 1, "r", "n", "p", 0.5, "w", "t")] * 2 + [(None, "no id", "xx", "s", 1, "r", "n", "p", 0.5, "w", "t"), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def every(spark):
    return [read(spark, "documents"), odd(spark)]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- 1


def brute_licenses(text):
    words = license_words(text)
    hits = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    for df in every(spark):
        got = plain((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect())
        assert got == plain((r.doc_id, *brute_licenses(r.text)) for r in df.collect())
    assert licenses.scan(none(spark)).count() == 0


def license_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_labels(text):
    """All labels and the best cover, by looking around every diagonal of every template; of passages that share more than half their words the best label counts."""
    words = license_words(text)
    grams = defaultdict(list)
    for k in range(len(words) - 2):
        grams[tuple(words[k : k + 3])].append(k)
    labels, best, notices = set(), 0.0, []
    for label, base, t in licenses.templates():
        hits = [(k - p, p) for p in range(len(t) - 2) for k in grams.get(tuple(t[p : p + 3]), [])]
        reach = 0 if base else -(-len(t) // licenses.SPREAD)
        least = 1 if base or len(t) <= licenses.SHORT else licenses.LEAST_COVER
        for d in {d for d, _ in hits}:
            near = [(e + p, p) for e, p in hits if abs(e - d) <= reach]
            cover = len({p for _, p in near}) / (len(t) - 2)
            if cover >= least and base:
                labels.add(label)
                best = max(best, cover)
            elif cover >= least:
                notices.append((label, min(k for k, _ in near), max(k for k, _ in near) + 3, cover, len(t)))
    for label, start, stop, cover, n in notices:
        if not any(o != label and 2 * (min(stop, b) - max(start, a)) > stop - start and (c, m) > (cover, n) for o, a, b, c, m in notices):
            labels.add(label)
            best = max(best, cover)
    return ",".join(sorted(labels)), best


def license_texts():
    whole = {label: text for label, text in licenses.NOTICES}
    rng = random.Random(8)
    mit, bsd = whole["mit"].split(), whole["bsd"].split()
    texts = [whole["mit"], whole["bsd"], whole["mit"].replace("free of charge", "free of any charge"), " ".join(mit[:8]), "licensed under the gnu general public license version 2", "nothing here"]
    texts += [" ".join([*mit[:3] * 12, *mit]), " ".join([*bsd[:3] * 12, *bsd[:24]]), " ".join([*mit[:14], *("put in four words".split()), *mit[14:]]), " ".join([*mit[:80], *["x"] * 200, *mit[80:]])]
    for _ in range(30):
        t = rng.choice(licenses.NOTICES)[1].split()
        texts.append(" ".join(w for w in t for w in ([w] if rng.random() > 0.04 else [w, "odd"] if rng.random() > 0.5 else [])))
    texts += ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under a Creative Commons Attribution 3.0 International License", "// SPDX-License-Identifier: Apache-2.0", "under the terms of the GNU General Public License version 2", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", "SPDX-License-Identifier: BSD-3-Clause"]
    return texts + [" ".join(rng.choice(texts[:10]) for _ in range(4)), None, ""]


@pytest.mark.parametrize("tile", [1 << 12, 64])
def test_license_notices(spark, monkeypatch, tile):
    monkeypatch.setattr(licenses, "TILE", tile)
    texts = license_texts()
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == ("mit", 1.0) and got[3][0] == "" and got[4][0] == "gpl-2" and got[5] == ("", 0.0)
    assert got[6][0] == "mit" and got[7][0] == "bsd" and got[8][0] == "mit"
    last = texts.index("SPDX-License-Identifier: BSD-3-Clause")
    assert [got[k][0] for k in range(last - 5, last + 1)] == ["cc-by-sa", "cc-by", "apache-2", "gpl-2", "gpl-3", "bsd"]
    for k, t in enumerate(texts):
        want = brute_labels(t)
        assert got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-12, (k, got[k], want)


# ---- 2


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark):
    for df in every(spark):
        got = quality.rules(df).collect()
        assert plain(tuple(r)[:7] for r in got) == plain((r.doc_id, *brute_quality(r.text)) for r in df.collect())
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.rules(none(spark)).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in quality.rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if not r.base_failed and r.doc_id in labels]
    clean, junk = [r.kept for r in got if labels[r.doc_id]], [r.kept for r in got if not labels[r.doc_id]]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.25 * len(junk)


def test_quality_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.op2_quality(spark, DATA)
    assert plain(df.collect()) == plain(con.sql(queries.oracle_sql()["op2_quality"]).select(*map(duckdb.ColumnExpression, df.columns)).fetchall())


# ---- 3


def test_top_k(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    assert plain(topk.top_k(read(spark, "embeddings")).collect()) == plain(con.sql(queries.oracle_sql()["op3_topk"]).fetchall())


def test_top_k_ties_and_gaps(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], "r") for i in range(130)] + [(200, None, "r"), (250, [1.0, None, 2.0], "r"), (251, [float("inf"), 0.0, 1.0], "r"), (300, [0.0, 0.0, 0.0], "r"), (350, [1.0], "r"), (None, [1.0, 1.0, 1.0], "r"), (400, [], "r"), (401, [], "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    valid = [(i, v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in valid:
        if q % 50 == 0:
            best = sorted((-int(sum(256 * a * 256 * b for a, b in zip(v, w))), i) for i, w in valid if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert plain(topk.top_k(df).collect()) == plain(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_threshold_search_stops():
    """The share of rows scored: all where no dimension tells more than others, few where some do."""
    rng = np.random.default_rng(4)
    for spread, least, most in ((np.ones(32), 0.9, 1.0), (0.5 ** np.arange(32), 0.0, 0.3)):
        matrix = np.floor(256 * rng.normal(size=(2000, 32)) * spread)
        orders = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T)
        ids, share = np.arange(2000), []
        for own in range(0, 2000, 100):
            scores = matrix @ matrix[own]
            want = sorted((-int(scores[i]), i) for i in range(2000) if i != own)[:5]
            got, read = topk.threshold_search(matrix[own], matrix, orders, ids, own, 5)
            assert [(-s, i) for s, i in got] == want
            share.append(read / 1999)
            again, less = topk.threshold_search(matrix[own], matrix, orders, ids, own, 5, floor=-want[0][0] + 1)
            assert less <= read and all(s <= -want[0][0] for s, _ in again)
        assert least <= np.mean(share) <= most, np.mean(share)


def test_threshold_searches_with_ties(monkeypatch):
    """Queries searched together, with repeated ids, a third of the rows equal, and few rows at once."""
    rng = np.random.default_rng(1)
    for turn in range(200):
        n, d, k = int(rng.integers(1, 300)), int(rng.integers(1, 6)), 5
        matrix = rng.integers(-2, 3, (n, d)).astype(float)
        matrix[: n // 3 if turn % 3 == 0 else 0] = matrix[0]
        ids = rng.permutation(np.sort(rng.integers(0, n if turn % 2 else 10 * n, n)))
        asked, own = matrix[rng.integers(0, n, 7)], ids[rng.integers(0, n, 7)]
        orders = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T)
        monkeypatch.setattr(topk, "SLICE", int(rng.integers(6, 100)))
        scores, rows, _ = topk.threshold_searches(asked, matrix, orders, ids, own, k, np.full(7, -np.inf))
        for j in range(7):
            want = sorted((-float(matrix[i] @ asked[j]), int(ids[i])) for i in range(n) if ids[i] != own[j])[:k]
            assert [(-scores[j, c], int(ids[rows[j, c]])) for c in range(k) if rows[j, c] >= 0] == want


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    df = read(spark, "embeddings")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    assert plain(topk.top_k(df).collect()) == plain(con.sql(queries.oracle_sql()["op3_topk"]).fetchall())


# ---- 4


def brute_removal(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if n[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 6, 7, 50, 700):
        for top in (1, 3, 300):
            text = rng.integers(1, top + 1, n)
            assert suffixes.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("most", [4096, 1])
def test_removal(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    for df in every(spark):
        rows = df.collect()
        assert plain(suffixes.removal(df).collect()) == plain((r.doc_id, *x) for r, x in zip(rows, brute_removal([r.text for r in rows])))
    assert suffixes.removal(none(spark)).count() == 0


def test_removal_by_one_order_of_all_contexts(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(suffixes.removal(df, across=True).collect()) == plain((i, *x) for (i, _), x in zip(rows, brute_removal([t for _, t in rows])))
    assert suffixes.removal(df.limit(0), across=True).count() == 0


@pytest.mark.parametrize("top,depth", [(1, 12), (3, 40)])
def test_difference_cover_over_many_strings(spark, top, depth):
    rng = random.Random(top)
    made = [[rng.randint(1, top) for _ in range(rng.randint(1, 60))] for _ in range(50)] + [[1] * 50] * 20 + [[]]
    rows = [(i, max(0, min(rng.randint(1, 60), len(x) - depth + 1)), x) for i, x in enumerate(made)]
    df = spark.createDataFrame(rows, "sid long, need int, syms array<long>")
    order = {r.sid: r.r for r in difference_cover.ranks(df, depth, True).collect()}
    begins = [b for _, b in sorted((order[s][i], x[i : i + depth]) for s, n, x in rows for i in range(n))]
    assert begins == sorted(begins)
    times = Counter(tuple(x[i : i + depth]) for _, n, x in rows for i in range(n))
    assert plain(difference_cover.repeated(df, depth).collect()) == plain((s, i) for s, n, x in rows for i in range(n) if times[tuple(x[i : i + depth])] > 1)


def test_without_repeats_keeps_columns(spark):
    df = odd(spark)
    out = suffixes.without_repeats(df)
    assert out.schema == df.schema and out.count() == df.count()


# ---- 5


def pack(df):
    return packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_packing_round_trip(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in every(spark):
        rows = df.collect()
        ids = [library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows]
        left = defaultdict(list)
        for r, x in zip(rows, ids):
            left[r.doc_id].append(x)
        pieces = pack(df).collect()
        want = Counter((doc, len(x)) for doc, xs in left.items() for x in xs)
        assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == want
        assert sum(p.length for p in pieces) == sum(map(len, ids))
        for p in pieces:
            assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in left[p.doc_id])
        windows = defaultdict(list)
        for p in pieces:
            windows[p.sequence_id].append(p)
        for ps in windows.values():
            at = 0
            for p in sorted(ps, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048 and at & (at - 1) == 0
        steps = Counter()
        for ps in windows.values():
            steps[ps[0].step_id] += sum(p.length for p in ps)
        assert max(steps.values()) <= packing.STEP_IDS
    assert pack(none(spark)).count() == 0


# ---- 6


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 701)
    n = Counter(table)
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    orders = {}
    for i, s in enumerate(names):
        offset, step = (int(hashlib.sha256(f"{k}|{s}".encode()).hexdigest()[:15], 16) for k in ("offset", "step"))
        orders[i] = [(offset % 701 + j * (step % 700 + 1)) % 701 for j in range(701)]
        assert sorted(orders[i]) == list(range(701))
    want = {}
    while len(want) < 701:
        for i in range(7):
            if len(want) < 701:
                want[next(x for x in orders[i] if x not in want)] = i
    assert table == [want[s] for s in range(701)]
    fewer = sharding.lookup_table(names[:6], 701)
    assert sum(a != b for a, b in zip(table, fewer) if a < 6) < 0.3 * 701
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 700)


def test_sharding(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert plain(queries.op6_sharding(spark, DATA).collect()) == plain(con.sql(queries.oracle_sql()["op6_sharding"]).fetchall())
    df = odd(spark)
    got = sharding.place(df)
    assert got.count() == df.count() and got.where("shard is null").count() == 0
    assert sharding.place(none(spark)).count() == 0


# ---- 7


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = language.identify(df).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    df = odd(spark)
    got = language.predict(df, language.fit(df))
    assert got.count() == df.count() and "score" in got.columns and set(got.columns) >= set(df.columns)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got.collect() if r.text is None or not any(c.isalpha() for c in r.text))
    assert language.identify(none(spark)).count() == 0
    blank = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(blank).first().lang_pred == "und"


def naive_forward(model, raw):
    """The network by loops over windows, filters and places."""
    total = np.zeros(len(model.languages))
    for low in range(0, len(raw), language.WINDOW):
        part = raw[low : low + language.WINDOW]
        x = list(part) + [0] * (language.WINDOW - len(part))
        pooled = []
        for k, f in enumerate(model.filters):
            for c in range(language.FILTERS):
                best = max(sum(float(f[j][x[i + j]][c]) for j in range(len(f))) for i in range(len(x) - len(f) + 1))
                pooled.append(max(0.0, best + float(model.bias[k][c])))
        z = np.array(pooled) @ model.weights.astype(float) + model.offset
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(part)
    return total / max(1, len(raw))


def test_language_forward_pass(spark):
    model = language.fit(read(spark, "documents"))
    texts = ["a", "the of and", "der die und das " * 40, "é" * 300, "x" * 513]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        p = naive_forward(model, t.encode())
        assert got[k].lang_pred == model.languages[p.argmax()] and abs(got[k].score - p.max()) < 1e-4
    signs = spark.createDataFrame([(0, "\u00b2\u00b3 \u00bd 12"), (1, "_ 7 \u2460")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.predict(signs, model).collect()] == [("und", 0.0)] * 2


def test_windows_cover_every_byte():
    data, offsets = np.arange(1, 201, dtype=np.uint8), np.array([0, 0, 70, 200])
    x, row = language.windows(data, offsets, 64)
    assert row.tolist() == [1, 1, 2, 2, 2] and x[x > 0].tolist() == data.tolist()


# ---- 8


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        words = bytes(r.text or "", "utf-8").lower().split()
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    ids = sorted({r.doc_id for r in rows if r.doc_id is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = [k for k, r in enumerate(rows) if r.doc_id is not None and sets[k]]
    for n, a in enumerate(live):
        for b in live[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(rows[a].doc_id), find(rows[b].doc_id)))
                parent[y] = x
    return [(r.doc_id, len(s), None if r.doc_id is None else find(r.doc_id)) for r, s in zip(rows, sets)]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    near = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"v{rng.randint(0, 99)}"
        near.append((1000 + i, " ".join(words)))
    crowd = spark.createDataFrame(near, "doc_id long, text string")
    small = odd(spark).dropDuplicates(["doc_id"]).unionByName(odd(spark).where("doc_id is null")).withColumn("doc_id", F.col("doc_id") + 5000)
    df = small.unionByName(crowd, allowMissingColumns=True).unionByName(read(spark, "documents"), allowMissingColumns=True)
    rows = df.select("doc_id", "text").collect()
    got = neardup.near_duplicates(df, size, percent).collect()
    assert plain(tuple(r)[:3] for r in got) == plain(brute_components(rows, size, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(none(spark)).count() == 0


def test_near_duplicates_families_of_a_template(spark):
    frame = [f"t{i}" for i in range(80)]
    rows = [(2 * f + m, " ".join([*frame, *(f"f{f}x{i}" for i in range(10)), *(f"o{f}x{m}x{i}" for i in range(10))])) for f in range(500) for m in range(2)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in rows}


def template_twins(groups, words, changes):
    """Twins one word apart, all made from one template by changes from a shared set of words."""
    rng = random.Random(4)
    rows = []
    for g in range(groups):
        one = [f"t{i}" for i in range(words)]
        for p in rng.sample(range(words), changes):
            one[p] = f"s{rng.randrange(50)}"
        two = list(one)
        two[rng.randrange(words)] = f"x{g}"
        rows += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(two))]
    return rows


def test_near_duplicates_twins_in_a_crowd(spark):
    rows = template_twins(4000, 300, 8)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in rows}


def test_near_duplicates_crowds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WIDE", 100)
    rng = random.Random(6)
    rows = template_twins(120, 90, 2) + template_twins(60, 60, 4)
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(1000 + k, " ".join(rng.sample([f"t{i}" for i in range(90)], 90))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert plain(tuple(r)[:3] for r in got) == plain(brute_components(df.collect(), 3, 85))


def test_overlaps_and_marks():
    rng = np.random.default_rng(1)
    xs = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(70)]
    ys = [np.unique(np.concatenate([rng.integers(0, 3000, 50), rng.integers(0, 20, 10)]).astype(np.uint64)) for _ in range(90)]
    want = [[len(np.intersect1d(a, b)) for b in ys] for a in xs]
    assert neardup.overlaps(xs, ys, columns=7).tolist() == want
    signs = lambda v: np.unpackbits(neardup.mark(v)).astype(float) * 2 - 1
    for n in (5, 40, 300, 5000):
        for _ in range(20):
            x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            y = np.concatenate([x[: -(-n * 92 // 100)], rng.integers(1, 1 << 62, n // 12).astype(np.uint64)])
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            assert true < 0.85 or signs(x) @ signs(y) / 2048 >= neardup._least(np.array([len(x)]), 85)[0]


def test_near_duplicates_repeated_rows(spark):
    got = neardup.near_duplicates(odd(spark)).where("doc_id = 3").collect()
    assert len(got) == 3


# ---- 9


def test_html_truth(spark):
    pages = {r.page_id: r.html for r in read(spark, "pages").collect()}
    import html as ref

    for r in html.extract(read(spark, "pages")).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(ref.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_edges(spark):
    page = "<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><header>Top menu words</header><nav><a href=x>Home</a></nav><div><p>One &amp; <b>two</b>three\n words of a long enough main text here</p><aside>aside words</aside><form>field <input> send</form><p>last&nbsp;block with more words</p></div><div class='comments'>Reader says hello there friend</div><footer>foot</footer>"
    rows = [(1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "plain text only"), (4, "u", "<p>unclosed <b"), (5, "u", "<nav>" * 50 + "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[1] == "One & twothree words of a long enough main text here last block with more words"
    assert got[2] == "" and got[None] == "" and got[3] == "plain text only" and got[4] == "unclosed"
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_all_articles_and_no_markup(spark):
    weights = html.learn(read(spark, "pages"))
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    page = f"<body><nav><a>menu</a></nav><article><h1>{words('t', 5)}</h1><p>{words('a', 60)}</p><aside>{words('side', 80)}</aside><p class='share of market'>{words('b', 9)}</p></article><div class=ad>{words('ad', 9)}</div><article><div class='article-header'><h1>{words('h', 6)}</h1></div><p>{words('c', 40)}</p></article><footer>{words('f', 9)}</footer>"
    want = " ".join(words(*x) for x in (("t", 5), ("a", 60), ("b", 9), ("h", 6), ("c", 40)))
    assert html.main_text(page, weights) == html.main_text(page, {}) == want
    assert html.main_text(f"<p>{words('a', 20)}</p><p title=\"x>lost words</p><p>last", {}) == words("a", 20) + " lost words last"
    plain_page = page.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html.main_text(plain_page, weights) == want


#: Pages by hand: what the article holds, and what stands around it.
HAND = {
    "ends in a list": ("<div><h1>Head of it</h1><p>{a}</p><ul><li>one</li><li>two</li><li>three</li></ul></div>", "Head of it {a} one two three"),
    "ends in short blocks": ("<main><p>{a}</p><div>one</div><div><div>two</div></div><div>three four</div></main>", "{a} one two three four"),
    "ends in a link": ("<div><p>{a}</p><p>See <a href=x>this</a></p></div>", "{a} See this"),
    "begins with a list": ("<div><ol><li>first</li><li>second</li></ol><p>{a}</p></div>", "first second {a}"),
    "links between paragraphs": ("<div><p>{a}</p><ul>" + "<li><a href=x>link</a></li>" * 20 + "</ul><p>{b}</p></div>", "{a} " + "link " * 20 + "{b}"),
    "a menu between articles": ("<article><p>short first one</p></article><nav>" + "<a href=x>Go there</a>" * 50 + "</nav><article><p>{b}</p></article>", "short first one {b}"),
    "a long aside": ("<div><p>few words</p><aside>" + "<p>aside words</p>" * 2000 + "</aside><p>{b}</p></div>", "few words {b}"),
    "a table": ("<div><p>{a}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>2024</td><td>5</td></tr></table></div>", "{a} Year Sum 2024 5"),
    "classes never met": ("<div class='teaser'><p>Read more of it</p></div><div><p>{a}</p></div><div class='copyright'>All rights held</div>", "{a}"),
    "a plain menu before": ("<ul>" + "<li><a href=x>Home</a></li>" * 6 + "</ul><div><p>{a}</p></div>", "{a}"),
    "nested markup": ("<div><p>{a} <em>with <strong>strong</strong></em> <code>x</code></p><blockquote><p>quoted</p></blockquote></div>", "{a} with strong x quoted"),
}


@pytest.mark.parametrize("size", ["learned on a thousand", "learned on few", "priors"])
def test_html_pages_by_hand(spark, size):
    """Lists, links, short blocks and several articles stay whole; menus, asides and notices go."""
    weights = {} if size == "priors" else html.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet") if "thousand" in size else read(spark, "pages"))
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(12))
    for name, (page, want) in HAND.items():
        whole = f"<html><body><header>Site name</header><nav><ul><li><a>menu</a></li></ul></nav>{page.format(a=a, b=b)}<footer>foot words</footer></body></html>"
        assert html.main_text(whole, weights) == want.format(a=a, b=b), name


def test_html_region_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        gains = [rng.choice((-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)) for _ in range(rng.randint(0, 14))]
        low, high = html.region(gains)
        ranges = [(sum(gains[i:j]), i, j) for i in range(len(gains)) for j in range(i, len(gains) + 1)]
        assert sum(gains[low:high]) == max([0.0, *(x[0] for x in ranges)])
    weights = {"word": 1.0, "p": -0.5, "/p": -0.5, "div": -2.0, "/div": -2.0}
    for _ in range(100):
        page = "".join(rng.choice(("<p>", "</p>", "<div>", "</div>", "one ", "two words ", "<b>", "</b>", "<nav>", "</nav>")) for _ in range(12))
        parts, gains = html.scored(page, weights)
        best = max((sum(gains[i:j]), -i, -j) for i in range(len(gains) + 1) for j in range(i, len(gains) + 1))
        low, high = html.region(gains)
        assert abs(sum(gains[low:high]) - max(0.0, best[0])) < 1e-9
        assert html.main_text(page, weights) == " ".join(" ".join(t for t, inside, _ in parts[low:high] if t and inside).split()) or "<p>" in page or "div" in page or "nav" in page


@pytest.mark.parametrize("page", ["<a " * 3_000_000 + '"', "<a \"x\" '" * 1_000_000, "<div>" * 2_000_000 + "x", "<nav><p>" * 1_000_000 + "</nav>" * 1_000_000, "<!-" * 3_000_000, "<script>" * 1_000_000, "</x" * 3_000_000, "<p>word " * 1_200_000], ids=range(8))
def test_html_long_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html.main_text(page, {})
    assert time.process_time() - began < 60


def test_html_repeated_rows(spark):
    df = read(spark, "pages").limit(3)
    got = [tuple(r) for r in html.extract(df.unionByName(df)).collect()]
    assert len(got) == 6 and len(set(got)) == 3


# ---- 10


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in every(spark):
        want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect()]
        got = bpe.encode(df, path)
        assert plain(got.collect()) == plain((d, x, library.decode(x, skip_special_tokens=False)) for d, x in want)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert plain(bpe.encode_digest(df, path).collect()) == plain((d, len(x), digest(" ".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False))) for d, x in want)
    assert bpe.encode_digest(none(spark), path).count() == 0


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    from tidemark.llm import _pieces

    real = _pieces.span_hashes
    monkeypatch.setattr(_pieces, "span_hashes", lambda *a: real(*a) % np.uint64(5) + np.uint64(1))
    words = _pieces.Words()
    rng = random.Random(3)
    seen = []
    for _ in range(20):
        pieces = [bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(50)]
        ends = np.cumsum([len(p) for p in pieces])
        numbers, new = words.number(np.frombuffer(b"".join(pieces), np.uint8), np.append(0, ends[:-1]), ends)
        seen += new
        assert [seen[n] for n in numbers] == pieces
    assert len(seen) == len(set(seen)) == words.total


@pytest.mark.parametrize("name", ["op1_licenses", "op4_suffixes", "op8_neardup"])
def test_sql_forms(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.queries()[name](spark, DATA)
    assert plain(df.collect()) == plain(con.sql(queries.oracle_sql()[name]).select(*map(duckdb.ColumnExpression, df.columns)).fetchall())


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "repeats", "packing"]
    docs = read(spark, "documents")
    columns = docs.columns
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, DATA).cache()
        assert kept.columns == columns
    rows = docs.collect()
    left = {r.doc_id: r for r in kept.collect()}
    assert 0 < len(left) < len(rows)
    good = {r.doc_id for r in quality.rules(docs).where("kept").collect()}
    assert set(left) <= good
    stay = docs.where(F.col("doc_id").isin(sorted(left)))
    raw = {r.doc_id: x for r, x in zip(stay.collect(), brute_removal([r.text for r in stay.collect()]))}
    assert all(len(left[d].text.encode()) == raw[d][0] - raw[d][1] for d in left)
    pieces = corpus_pipeline.run(spark, DATA)
    assert {p.doc_id for p in pieces.collect()} == set(left)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty tables, repeated rows and clashing names keep their columns in every stage; no n_chars is needed."""
    import corpus_pipeline

    names = ["q_words", "r_words", "q_row", "_row", "_spans", "lang_pred", "score", "node", "kept", "component_id"]
    docs = read(spark, "documents").limit(80).drop("n_chars")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None), (None, "", "xx", None), (7, None, "en", "s")], docs.schema))
    for name in names:
        docs = docs.withColumn(name, F.lit(f"{name} of the input"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for start in (spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, start, None)
            assert out.columns == docs.columns
            assert all(r[n] == f"{n} of the input" for r in out.collect() for n in names)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
