"""Byte-level coding, importance resampling and the conversation trie against brute force, the library or SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_operators import DATA, every, license_words, none, odd, odd_texts, plain, read
from tidemark.llm import _order, _work, byte_bpe, importance, queries, trie

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- 11


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_segment_tree():
    rng = random.Random(3)
    for n in (1, 2, 3, 8, 13, 64):
        ranks = [rng.randint(0, 5) for _ in range(n)]
        tree = byte_bpe.SegmentTree(list(ranks))
        for _ in range(60):
            assert tree.least() == min(ranks) and tree.first() == ranks.index(min(ranks))
            at = rng.randrange(n)
            ranks[at] = rng.choice([*range(6), byte_bpe._NONE])
            tree.put(at, ranks[at])


def coding_texts():
    rng = random.Random(7)
    letters = [*"abc éç漢😀ΣİK'\n\t 12#|<>", "'s", "'ll", " the ", "  ", "　", "\x1c", "\x85", "<|endoftext|>"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    return [*odd_texts(), *made, *("a" * n for n in (63, 64, 65, 1000, 20_000)), "ab" * 700, "漢字" * 500, " " * 3000, "=-" * 40, "word " * 60_000]


def test_byte_coding_is_the_librarys(spark, library):
    texts = coding_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = byte_bpe.encode(df, RANKS)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert [got[k] for k in range(len(texts))] == [library.encode_ordinary(t or "") for t in texts]
    back = {r.doc_id: bytes(r.content) for r in byte_bpe.decode(coded, RANKS).collect()}
    assert [back[k] for k in range(len(texts))] == [(t or "").encode() for t in texts]
    for frame in every(spark):
        want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in frame.collect()]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert plain(byte_bpe.encode_digest(frame, RANKS).collect()) == plain((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t)) for i, x, t in want)
    assert byte_bpe.encode_digest(none(spark), RANKS).count() == byte_bpe.encode(none(spark), RANKS).count() == 0


def test_merges_of_one_and_of_many(library):
    """The tree of one piece and the trees of many give the library's ids for random letters and bytes."""
    merger, rng = byte_bpe.coder(RANKS).merger, random.Random(11)
    pieces = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 64))).encode() for _ in range(400)] + [rng.randbytes(rng.randint(1, 70)) for _ in range(400)]
    ids, counts = merger.encode(pieces)
    for piece, got in zip(pieces, np.split(ids, np.cumsum(counts)[:-1])):
        want = library._core_bpe.encode_single_piece(piece)
        assert got.tolist() == want
        assert piece in merger.ranks or merger.merge(piece) == want


def test_decode_refuses_unknown_ids(spark):
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.content) for r in byte_bpe.decode(empty, RANKS).collect()} == {1: b"", 2: b""}
    with pytest.raises(ValueError):
        byte_bpe.coder(RANKS).decode(np.array([10**6]))


def test_long_rows_are_cut_between_pieces(library):
    texts = ["a bc  def\n g" * 50, "", "x" * 500, " " * 300 + "y z" * 100, "　 a" * 100, None, "short"]
    data, offsets = byte_bpe.column_bytes(pa.array(texts))
    parts = defaultdict(list)
    for rows, cuts in byte_bpe.segments(data, offsets, 64):
        for row, low, high in zip(rows.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            parts[row].append(data[low:high].tobytes().decode())
    for k, t in enumerate(texts):
        assert "".join(parts[k]) == (t or "")
        assert [i for p in parts[k] for i in library.encode_ordinary(p)] == library.encode_ordinary(t or "")
    assert len(parts[0]) > 5 and len(parts[2]) == 1


# ---- 12


def brute_resample(rows, target, low=1, high=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        words = license_words(text)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    read = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in read for b in f), Counter(b for x in target for b in features(x)[1])
    every, aimed = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every + buckets) / ((s[b] + 1) * (aimed + buckets))))
    out = []
    for i, n, f in read:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k in range(percent * len(able) // 100):
        able[k][5] = k + 1
    return plain(map(tuple, out))


@pytest.mark.parametrize("grams,percent,least", [((1, 1), 10, 20), ((1, 2), 60, 1), ((2, 3), 100, 0), ((1, 1), 0, 20)])
def test_resample(spark, grams, percent, least):
    target = read(spark, "benchmark").withColumn("rank", F.lit(1)).union(spark.createDataFrame([(None, None, 1), (1, "", 1)], "item_id long, text string, rank int"))
    aims = [r.text for r in target.collect()]
    for df in every(spark):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = importance.resample(df, target, grams, 500, percent, least)
        assert plain(got.collect()) == brute_resample(rows, aims, *grams, 500, percent, least)


def test_resample_of_nothing(spark):
    blank = read(spark, "benchmark").limit(0)
    assert importance.resample(none(spark), read(spark, "benchmark")).count() == 0
    df = read(spark, "documents")
    assert plain(importance.resample(df, blank).collect()) == brute_resample([(r.doc_id, r.text) for r in df.collect()], [])


def test_resample_oracle(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.op12_importance(spark, DATA)
    assert plain(df.collect()) == plain(con.sql(queries.oracle_sql()["op12_importance"]).select(*map(duckdb.ColumnExpression, df.columns)).fetchall())


def scores(spark, values):
    return spark.createDataFrame([(k, 20, 20, 0, v) for k, v in enumerate(values)], "doc_id long, n_words long, n_features long, weight long, score long")


@pytest.mark.parametrize("error", [0.001, 0.3])
def test_bracket_holds_the_kth_score(spark, error):
    rng = random.Random(4)
    for values in ([rng.randint(-50, 50) for _ in range(400)], [7] * 300, [0] * 299 + [1], list(range(250))):
        rows = _work.saved(scores(spark, values))
        ranked = sorted(values, reverse=True)
        for k in (1, len(values) // 10, len(values)):
            low, high, above = importance.bracket(rows, k, len(values), error)
            assert low <= ranked[k - 1] <= high and above == sum(v > high for v in values) < k


def test_bracket_is_widened(spark, monkeypatch):
    """A sketch that is far off costs another look, no row."""
    rows = _work.saved(scores(spark, list(range(1000))))
    seen = []

    def wrong(self, column, shares, error):
        seen.append(shares)
        return [5.0, 6.0]

    monkeypatch.setattr(type(rows), "approxQuantile", wrong)
    low, high, above = importance.bracket(rows, 100, 1000)
    assert low <= 900 <= high and above == 0 and len(seen) >= 2


def test_ties_go_to_smaller_ids(spark):
    got = importance.draw(_work.saved(scores(spark, [3] * 40 + [4] * 5)), 50, 0)
    assert sorted((r.rank, r.doc_id) for r in got.where("rank is not null").collect()) == list(enumerate([*range(40, 45), *range(17)], 1))


def test_drawn_keeps_columns(spark):
    df = odd(spark).withColumn("rank", F.lit("own"))
    result = importance.resample(df, read(spark, "benchmark"), percent=50, least_words=1)
    out = importance.drawn(df, result)
    ids = {r.doc_id for r in result.where("rank is not null").collect()} - {None}
    assert out.columns == ["doc_id", *(c for c in df.columns if c != "doc_id"), "rank_"]
    assert {r.doc_id for r in out.collect()} == ids and out.count() == df.where(F.col("doc_id").isin(ids)).count()


# ---- 13


def brute_trie(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in held.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(s[:-1] for s in members if s)
    out = []
    for s, cs in members.items():
        below = [x for x in members if x[: len(s)] == s]
        tokens = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(cs) if whole[c] == s)
        out.append((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), kids[s], sum(not kids[x] for x in below), tokens, hashlib.sha256(ends.encode()).hexdigest()))
    return plain(out)


TURNS = "conv_id long, turn long, role string, text string, depth string, n string, rep string"


def odd_turns():
    rng = random.Random(6)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "b", "é漢"])) for c in range(60) for t in range(rng.randint(1, 12)) if c % 5 or c % 10]
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(4)]
    rows += [(c, t, "u", "deeper") for c in (200, 201) for t in range(120)]
    rows += [(300, None, "u", "first"), (300, 1, None, None), (300, 2, "u", ""), (301, 1, "", "u"), (302, 1, "u", ""), (303, None, None, None), (-3, 1, "u", "minus"), (-5, 1, "v", "base"), (-7, 2, "v", "minus"), (0, 1, "u", "zero")]
    rows += [(400, 3, "u", "twice"), (400, 3, "u", "twice"), (402, 1, "u", "one"), (404, 1, "u", "one"), (None, 1, "u", "nobody"), (None, None, None, None)]
    return rows


def turn_rows(spark, rows):
    return spark.createDataFrame([(*r, "d", "n", "r") for r in rows], TURNS)


@pytest.mark.parametrize("hot,chunk", [(1000, 1 << 16), (3, 8)])
def test_trie(spark, monkeypatch, hot, chunk):
    """The second case deals all long conversations and common nodes over parts, and cuts end lists into chunks of a few ids."""
    monkeypatch.setattr(_work, "HOT", hot)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    assert plain(trie.trie_digest(turn_rows(spark, odd_turns())).collect()) == brute_trie(odd_turns())


def test_trie_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    df = queries.op13_trie(spark, DATA)
    got = plain(df.collect())
    assert got == plain(con.sql(queries.oracle_sql()["op13_trie"]).select(*map(duckdb.ColumnExpression, df.columns)).fetchall())
    assert got == brute_trie([tuple(r) for r in read(spark, "conversations").select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_nothing(spark):
    assert trie.trie_digest(turn_rows(spark, [])).count() == 0
    assert trie.trie_digest(turn_rows(spark, [(None, 1, "u", "x")])).count() == 0
    only = trie.trie_digest(turn_rows(spark, [(3, 1, "u", "x")])).collect()
    assert plain(only) == brute_trie([(3, 1, "u", "x")])


def test_end_lists_are_whole(spark):
    ends = spark.createDataFrame([(i, 2, 7, 7, 0) for i in range(500)] + [(9000, 2, 7, 8, 0)], "conv_id long, depth long, p1 long, p2 long, total long")
    chunks = sorted((r.p2, r.part, r.no, r.ids) for r in trie.end_lists(ends).collect())
    assert ",".join(x[3] for x in chunks if x[0] == 7) == ",".join(map(str, range(500))) and chunks[-1][3] == "9000"


def test_running_totals_go_on_over_ranges(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(-9, 9), rng.getrandbits(62)) for k, n in ((1, 1), (2, 5000), (3, 1), (4, 300), (5, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long, x long")
    got = {(r.k, r.i): (r.total, r.mixed) for r in _order.running(df, "k", [F.asc("i")], {"total": "v"}, {"mixed": "x"}).collect()}
    total, mixed = Counter(), Counter()
    for k, i, v, x in rows:
        total[k] += v
        mixed[k] ^= x
        assert got[k, i] == (total[k], mixed[k])
    numbers = _order.numbered(df, [F.desc("v"), F.asc("x")], "number").orderBy("number").collect()
    assert [r.number for r in numbers] == list(range(1, len(rows) + 1)) and [(r.v, r.x) for r in numbers] == sorted(((v, x) for _, _, v, x in rows), key=lambda r: (-r[0], r[1]))
