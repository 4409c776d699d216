"""Removal of repeated passages with suffix arrays by the difference-cover algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import difference_cover
from tidemark.llm._text import _byte_codes, _powers, chunks, column_bytes, mix, ragged
from tidemark.llm._work import fresh, hot_join, hot_keys, saved

#: Bytes of a passage.
LENGTH = 200
#: Every passage has one anchor: of its WINDOW k-grams of CORE bytes, the last with the least hash.
WINDOW = 101
CORE = LENGTH - WINDOW + 1
#: Contexts of one core that a suffix array takes; a core with more is split into longer cores.
MOST_CONTEXTS = 4096
#: Symbols of one suffix array; under 2 ** 21, so that three ranks fit a 63-bit key.
MOST_SYMBOLS = 1 << 20
#: The anchor of a passage has the least leading half of a hash, the last of those on ties.
_HALF = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)


# ---- difference cover modulo 3 -------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of `text` (integers from 1 on, under 2 ** 21 of them and as large).

    Sorts the triples at positions 1 and 2 modulo 3, recurses on their names until all differ, sorts the
    rest by their first symbol and the next rank, and merges both orders.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.int64)
    base = np.int64(t.max() + 1)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    triples = (t[sampled] * base + t[sampled + 1]) * base + t[sampled + 2]
    order = np.argsort(triples, kind="stable")
    names = np.empty(len(sampled), np.int64)
    ordered = triples[order]
    names[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
    if names.max() < len(sampled):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled[order]] = np.arange(1, len(sampled) + 1)
    most = np.int64(len(sampled) + 1)
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] * most + rank[zeros + 1], kind="stable")]
    sample = sampled[order]
    sample = sample[sample < n]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[one] * most + rank[one + 1], t[zeros] * most + rank[zeros + 1])
    before += np.searchsorted((t[two] * base + t[two + 1]) * most + rank[two + 2], (t[zeros] * base + t[zeros + 1]) * most + rank[zeros + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zeros))
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = zeros
    out[rest] = sample
    return out


def repeated(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions `starts` begin a string of `length` symbols that also begins at another of them.

    Neighbours in the suffix array are compared by their prefixes.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text)
    order = order[wanted[order]]
    power, inverse = _powers(1 << max(20, (len(text) + length).bit_length()))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
    prefix = (sums[order + length] - sums[order]) * inverse[order]
    same = prefix[1:] == prefix[:-1]
    found = np.zeros(len(text), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return found[starts]


# ---- anchors --------------------------------------------------------------------------------


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(1 << max(21, (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def _strings(sums: np.ndarray, inverse: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, at, low, count, core, context of every anchor of the rows' passages.

    at: where its core begins in its row; low: where the first of its passages does, with `count` in a
    row; core and context: hashes of the core and of all bytes of its passages with the anchor's place.
    Equal passages have equal anchors at equal places in them.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    sizes = np.diff(offsets)
    valid = np.maximum(sizes - LENGTH + 1, 0)
    if not valid.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums, inverse = _sums(data)
    k = n - CORE + 1
    grams = mix((sums[CORE:] - sums[:k]) * inverse[:k])
    key = (grams >> _HALF << _HALF) | (_LOW - np.arange(k, dtype=np.uint64))
    padded = np.full(-(-k // WINDOW) * WINDOW, np.iinfo(np.uint64).max)
    padded[:k] = key
    ahead = np.minimum.accumulate(padded.reshape(-1, WINDOW), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, WINDOW)[:, ::-1], axis=1)[:, ::-1].ravel()
    first = ragged(offsets[:-1], valid)
    least = np.minimum(behind[first], ahead[first + WINDOW - 1])
    chosen = (_LOW - (least & _LOW)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), valid)
    new = np.ones(len(first), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(first)))
    low, at, row = first[begin], chosen[begin], row[begin]
    core = grams[at]
    context = mix(_strings(sums, inverse, low, low + count - 1 + LENGTH) + mix((at - low).astype(np.uint64)))
    return row, at - offsets[row], low - offsets[row], count, core, context


def _pack(at, low, count):
    """One long: where the core begins, how far before it the first passage does, how many passages."""
    return (at << 16) | ((at - low) << 8) | count


def _unpack(packed):
    return packed >> 16, (packed >> 8) & 255, packed & 255


def _keyed(docs: DataFrame) -> DataFrame:
    """`row`: a hash of doc_id and text. Rows that share it are copies of a row and share all results."""
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            for i, j in chunks(offsets):
                row, at, low, count, core, context = anchors(data, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][row]), pa.array(_pack(at, low, count)), pa.array(core.view(np.int64)), pa.array(context.view(np.int64))], ["row", "place", "core", "context"])

    return _keyed(docs).select("row", "text").mapInArrow(run, "row long, place long, core long, context long")


ITEM = "row long, place long, core long, single boolean, left binary, right binary"
_ITEM = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("core", pa.int64()), ("single", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _contexts(open_: DataFrame, docs: DataFrame) -> DataFrame:
    """The open anchors with the bytes before and after their cores that their passages have.

    A repeated row may give its contexts again; none of them is single, so that changes nothing.
    """
    places = open_.groupBy("row").agg(F.collect_list(F.struct("place", "core", "single")).alias("places"))
    texts = _keyed(docs).select("row", "text").join(places.hint("shuffle_hash"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                raw, base, out = data[offsets[i] : offsets[j]].tobytes(), int(offsets[i]), []
                for k in range(i, j):
                    row, start = batch.column(0)[k].as_py(), int(offsets[k]) - base
                    for p in batch.column(2)[k].as_py():
                        at, lead, count = _unpack(p["place"])
                        at += start
                        out.append((row, p["place"], p["core"], p["single"], raw[at - lead : at], raw[at + CORE : at - lead + count - 1 + LENGTH]))
                yield _table(out, _ITEM)

    return texts.select("row", "text", "places").mapInArrow(run, ITEM)


def _longer(items: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The items with longer cores: a passage that begins far before its core takes the bytes before into it, any other those after.

    How far it begins before decides alone, so equal passages still have equal cores.
    """
    more = (LENGTH - size + 1) // 2

    def name(core: int, side: bytes, taken: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(core.to_bytes(8, "little", signed=True) + side + taken, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, place, core, single, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                at, lead, count = _unpack(place)
                far = max(0, min(count, lead - more + 1))
                if far:
                    cut = len(left) - more
                    out.append((row, _pack(at - more, at - lead, far), name(core, b"<", left[cut:]), single, left[:cut], right[: LENGTH - size - lead + far - 1]))
                if count > far:
                    near = lead - far
                    out.append((row, _pack(at, at - near, count - far), name(core, b">", right[:more]), single, left[far:], right[more:]))
            yield _table(out, _ITEM)

    return items.mapInArrow(run, ITEM), size + more


def _spans(row: int, place: int, flags: np.ndarray) -> list[tuple[int, int, int]]:
    """Byte ranges that the flagged passages of an anchor cover."""
    at, lead, _ = _unpack(place)
    hit = np.flatnonzero(flags)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    return [(row, int(at - lead + part[0]), int(at - lead + part[-1] + LENGTH)) for part in np.split(hit, cut)]


def _by_suffix_array(contexts: DataFrame, size: int) -> DataFrame:
    """row, start, stop: repeated passages of contexts of the same core, by suffix arrays.

    Contexts are dealt by core and sorted in their partition, so that those of a core are in one suffix
    array, with the core of `size` bytes as one symbol and an end symbol for each context.
    """
    around = LENGTH - size + 1

    def solve(rows: list[tuple]) -> list[tuple]:
        cores = {c: 300 + i for i, c in enumerate(dict.fromkeys(r[2] for r in rows))}
        end = 300 + len(cores)
        parts, starts, at = [], [], 0
        for i, (_, place, core, _, left, right) in enumerate(rows):
            count = place & 255
            parts += [np.frombuffer(left, np.uint8).astype(np.int64) + 1, [cores[core]], np.frombuffer(right, np.uint8).astype(np.int64) + 1, [end + i]]
            starts.append(at + np.arange(count))
            at += len(left) + len(right) + 2
        found = repeated(np.concatenate(parts), np.concatenate(starts), around)
        out, low = [], 0
        for (row, place, _, single, _, _), own in zip(rows, starts):
            if single:
                out += _spans(row, place, found[low : low + len(own)])
            low += len(own)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_size = 0

        def give(rows):
            columns = list(zip(*solve(rows))) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "start", "stop"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and r[2] != held[-1][2]:
                    if held_size > MOST_SYMBOLS // 2:
                        yield give(held)
                        held, held_size = [], 0
                held.append(r)
                held_size += len(r[4]) + len(r[5]) + 2
        if held:
            yield give(held)

    dealt = contexts.select("row", "place", "core", "single", "left", "right").repartition("core").sortWithinPartitions("core")
    return dealt.mapInArrow(run, "row long, start long, stop long")


def _settled(items: DataFrame) -> DataFrame:
    """row, start, stop: the repeated passages of the single items.

    Cores of one item hold nothing repeated. Cores of MOST_CONTEXTS items or fewer go to suffix arrays.
    Larger ones are split by the bytes next to them into longer cores, as often as it takes; a core as
    long as a passage is one.
    """
    out, size = None, CORE
    while True:
        counts = saved(items.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("any")).where((F.col("n") > 1) & F.col("any")))
        items = saved(hot_join(items, counts, "core", ["row", "place"], hot_keys(counts, "core")))
        last = size == LENGTH
        small = items.where(F.lit(False) if last else F.col("n") <= MOST_CONTEXTS).drop("n", "any")
        large = items.where(F.lit(True) if last else F.col("n") > MOST_CONTEXTS).drop("n", "any")
        if last:
            start = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)
            found = large.where("single").select("row", start.alias("start"), (start + LENGTH).alias("stop"))
        else:
            found = _by_suffix_array(small, size)
        out = found if out is None else out.unionByName(found)
        if last or large.isEmpty():
            return out
        items, size = _longer(large.select("row", "place", "core", "single", "left", "right"), size)
        items = saved(items)


def _in_order(items: DataFrame) -> DataFrame:
    """row, start, stop: what `_settled` gives, by one order of the suffixes of all contexts, sorted by Spark.

    A context is one string: the bytes before its core, a mark and the eight bytes of the core's hash,
    the bytes after it; a mark stands nowhere else, so passages with cores at different places differ.
    """
    mark, beyond = 257, LENGTH - CORE + 9
    numbered = saved(items.withColumn("sid", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, place, core, left, right = batch.columns
            names = np.asarray(core, np.int64).astype("<i8").view(np.uint8).reshape(-1, 8)
            out = []
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(x[k].as_py(), np.uint8).astype(np.int64) + 1 for x in (left, right))
                out.append(np.concatenate([a, [mark], names[k].astype(np.int64) + 1, b]))
            at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            syms = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([sid, pa.array((np.asarray(place, np.int64) & 255).astype(np.int32)), syms], ["sid", "need", "syms"])

    strings = saved(numbered.select("sid", "place", "core", "left", "right").mapInArrow(run, "sid long, need int, syms array<long>"))
    found = difference_cover.repeated(strings, beyond).groupBy("sid").agg(F.collect_list("place").alias("hits"))
    single = numbered.where("single").select("sid", "row", "place").join(found.hint("shuffle_hash"), "sid")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, place, hits in zip(*(c.to_pylist() for c in batch.columns)):
                flags = np.zeros(256, bool)
                flags[hits] = True
                out += _spans(row, place, flags)
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "start", "stop"])

    return single.select("row", "place", "hits").mapInArrow(spans, "row long, start long, stop long")


def repeats(docs: DataFrame, across: bool = False) -> DataFrame:
    """row, start, stop: byte ranges, which may overlap, that together are all bytes in a repeated passage.

    1. Every passage of LENGTH bytes has an anchor that equal passages share. Anchors whose core occurs
       once hold no repeated passage and drop out before any text moves.
    2. An anchor whose whole context occurs twice has only repeated passages.
    3. The contexts left, where a repeat begins or ends, and one of each context of the same cores, are
       sorted by suffix arrays (difference cover modulo 3) and neighbours compared (see `_settled`);
       with `across`, by one distributed sort of all of them (see `_in_order`), at some forty times the cost of this step.

    Rows of cores and contexts that are very frequent are dealt over tasks in every join.
    """
    found = saved(_anchor_rows(docs))
    cores = saved(found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where(F.col("n") > 1))
    active = saved(hot_join(found, cores.select("core", "mixed"), "core", ["row", "place"], hot_keys(cores, "core")))
    mixed = saved(active.where("mixed").groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("first")))
    twice = mixed.where(F.col("n") > 1)
    whole = active.where(~F.col("mixed")).select("row", "place")
    whole = whole.unionByName(hot_join(active.where("mixed"), twice.select("context"), "context", ["row", "place"], hot_keys(twice, "context")).select("row", "place"))
    at, lead, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    sure = whole.select("row", (at - lead).alias("start"), (at - lead + count - 1 + LENGTH).alias("stop"))
    open_ = mixed.select(F.col("first.row").alias("row"), F.col("first.place").alias("place"), "core", (F.col("n") == 1).alias("single"))
    contexts = saved(_contexts(open_, docs))
    return sure.unionByName(_in_order(contexts) if across else _settled(contexts))


def _cut(raw: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left without the spans, the bytes removed, the maximal runs removed."""
    keep, at, removed, runs, stop = [], 0, 0, 0, -1
    for s in sorted((x["start"], x["stop"]) for x in spans):
        if s[0] > stop:
            runs += 1
            keep.append(raw[at : s[0]])
            removed += s[1] - s[0]
            stop = s[1]
        elif s[1] > stop:
            removed += s[1] - stop
            stop = s[1]
        at = max(at, stop)
    keep.append(raw[at:])
    return b"".join(keep), removed, runs


def _with_spans(docs: DataFrame, spans: str, across: bool = False) -> DataFrame:
    """The rows of `docs` with all their spans in a new column `spans` (null: none)."""
    row = fresh("_row", docs.columns)
    found = repeats(docs, across).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("start", "stop")).alias(spans))
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return keyed.join(found.hint("shuffle_hash"), row, "left").drop(row)


def removal(docs: DataFrame, across: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left of each text without repeated passages.

    A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in the same text or
    another; null texts are empty. A repeated row repeats its passages, so both lose all of 200 bytes or
    more. Rows with a null doc_id count like others; other columns are ignored; no rows give no rows. How
    the contexts are sorted (`across`, see `repeats`) changes no result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                out = []
                for k in range(i, j):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    left, removed, runs = _cut(raw, batch.column(2)[k].as_py() or [])
                    out.append((batch.column(0)[k].as_py(), len(raw), removed, runs, hashlib.sha256(left).hexdigest()))
                yield _table(out, schema)

    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "spans", across)
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages taken out of text; other columns as they are.

    Where a cut falls inside a character, the bytes of that character that are left go too. Null texts
    stay null.
    """
    names, at = docs.columns, next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    spans = fresh("_spans", names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(column_bytes(batch.column(at))[1]):
                part, texts = batch.slice(i, j - i), []
                for text, cuts in zip(part.column(at), part.column(len(names))):
                    text, cuts = text.as_py(), cuts.as_py()
                    texts.append(text if not cuts else _cut(text.encode(), cuts)[0].decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(len(names))], names)

    return _with_spans(docs, spans).select(*(F.col(f"`{c}`") for c in names), F.col(spans)).mapInArrow(run, docs.schema)
