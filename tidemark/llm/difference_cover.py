"""Suffix order of many strings at once by the difference-cover algorithm modulo 3, as Spark sorts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import _powers, mix, ragged
from tidemark.llm._work import saved

#: Symbols below this are packed three to a name without a sort.
PACKED = 1 << 20
_KEYS = ["sort", "k0", "k1", "k2"]
_ROW = "sort int, k0 long, k1 long, k2 long, kind int, sid long, j int, need int"


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null is an empty list."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.asarray(column.flatten(), np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element of lists of these lengths its list and its place there."""
    return np.repeat(np.arange(len(lengths)), lengths), ragged(np.zeros(len(lengths), np.int64), lengths)


def _at(values: np.ndarray, offsets: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """values[place] of each list, 0 beyond its end."""
    inside = place < (offsets[1:] - offsets[:-1])[row]
    out = np.zeros(len(row), np.int64)
    out[inside] = values[(offsets[row] + place)[inside]]
    return out


def smaller(rows: DataFrame) -> DataFrame:
    """sid, j, need, kind, less0, less1: how many rows of kind 0 and of kind 1 of the same sort have a smaller key.

    Rows are range partitioned by key and place, so that the rows of one key may lie in several partitions;
    what the driver reads to stitch partitions together is one row of each.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *_KEYS, "sid", "j").sortWithinPartitions(*_KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, less, first = TaskContext.get().partitionId(), None, np.zeros(2, np.int64), np.zeros(2, np.int64), True
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k), np.int64) for k in range(4)])
            kind = np.asarray(batch.column(4), np.int64)
            new = np.ones(len(kind), bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            new[0] = last is None or bool((keys[:, 0] != last).any())
            first = first and (last is None or not new[0])
            counts = [seen[q] + np.concatenate([[0], np.cumsum(kind == q)]) for q in (0, 1)]
            group = np.cumsum(new)
            heads = np.flatnonzero(new)
            out = [np.concatenate([[less[q]], counts[q][heads]])[group] for q in (0, 1)]
            head = (group == (0 if not new[0] else 1)) & first
            yield _batch(["part", "sort", "k0", "k1", "k2", "kind", "sid", "j", "need", "head", "less0", "less1"], np.full(len(kind), part, np.int32), *batch.columns, head, *out)
            first = bool(head[-1])
            last, less, seen = keys[:, -1], np.array([out[0][-1], out[1][-1]]), np.array([counts[0][-1], counts[1][-1]])

    local = saved(ordered.mapInArrow(run, "part int, sort int, k0 long, k1 long, k2 long, kind int, sid long, j int, need int, head boolean, less0 long, less1 long"))
    key = F.struct(*_KEYS)
    n = [F.count(F.when(F.col("kind") == q, 1)) for q in (0, 1)]
    ends = local.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max_by("head", key).alias("one"), F.max("less0").alias("m0"), F.max("less1").alias("m1"), n[0].alias("n0"), n[1].alias("n1")).orderBy("part").collect()
    offsets, total, carry, high = [], np.zeros(2, np.int64), np.zeros(2, np.int64), None
    for p in ends:
        head = carry if p["low"] == high else total
        offsets.append((p["part"], *map(int, head), *map(int, total)))
        carry = head if p["one"] else total + np.array([p["m0"], p["m1"]])
        total, high = total + np.array([p["n0"], p["n1"]]), p["high"]
    sorts = {r["sort"]: (r["n0"], r["n1"]) for r in local.groupBy("sort").agg(n[0].alias("n0"), n[1].alias("n1")).collect()}
    base = [F.lit(0), F.lit(0)]
    for s in sorted(sorts):
        before = [sum(v[q] for t, v in sorts.items() if t < s) for q in (0, 1)]
        base = [F.when(F.col("sort") == s, F.lit(before[q])).otherwise(base[q]) for q in (0, 1)]
    table = rows.sparkSession.createDataFrame(offsets, "part int, h0 long, h1 long, t0 long, t1 long")
    moved = local.join(F.broadcast(table), "part")
    less = [F.when(F.col("head"), F.col(f"h{q}")).otherwise(F.col(f"t{q}") + F.col(f"less{q}")) - base[q] for q in (0, 1)]
    return moved.select("sid", "j", "need", "kind", less[0].alias("less0"), less[1].alias("less1"))


def _strings(values: DataFrame, column: str) -> DataFrame:
    """sid, need, `column`: the values (sid, need, j, v) of each string in order; those of one place are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(block):
            sid, j, need, v = block
            heads = np.flatnonzero(np.concatenate([[True], (sid[1:] != sid[:-1]) | (j[1:] != j[:-1])]))
            sums, sid, need = np.add.reduceat(v, heads), sid[heads], need[heads]
            cuts = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(sid)), pa.int32()), pa.array(sums))
            return _batch(["sid", "need", column], sid[cuts], need[cuts].astype(np.int32), lists)

        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            block = np.concatenate([held, np.stack([np.asarray(c, np.int64) for c in batch.columns])], axis=1)
            if not block.shape[1]:
                continue
            cut = int(np.searchsorted(block[0], block[0, -1]))
            if cut:
                yield give(block[:, :cut])
            held = block[:, cut:]
        if held.shape[1]:
            yield give(held)

    return values.select("sid", "j", "need", "v").repartition("sid").sortWithinPartitions("sid", "j").mapInArrow(run, f"sid long, need int, {column} array<long>")


def _triples(strings: DataFrame, leaf: bool) -> DataFrame:
    """The triples of symbols at the needed places (leaf), or at all places 1 and 2 modulo 3 as places of the two half strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, need = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
            values, offsets = _lists(batch.column(2))
            sizes = np.diff(offsets)
            row, i = _places(np.minimum(sizes, need) if leaf else sizes)
            if not leaf:
                row, i = row[i % 3 > 0], i[i % 3 > 0]
            keys = [_at(values, offsets, row, i + k) for k in range(3)]
            half = i % 3 - 1
            names = sid[row] if leaf else sid[row] * 2 + half
            place = i if leaf else i // 3
            wanted = need[row] if leaf else np.where(half == 0, need[row] // 3 + 1, (need[row] + 2) // 3)
            zero = np.zeros(len(row), np.int32)
            yield _batch([c.split()[0] for c in _ROW.split(", ")], zero, *keys, zero, names, place.astype(np.int32), wanted.astype(np.int32))

    return strings.select("sid", "need", "syms").mapInArrow(run, _ROW)


def _merged(strings: DataFrame) -> DataFrame:
    """Rows of the three sorts of two classes of places each, from strings with the ranks r1, r2 of their halves.

    Places 0 and 1 modulo 3 compare by a symbol and the next rank, 2 and 0 by two symbols and a rank, 1 and
    2 by their ranks. The first class of a sort (kind 0) counts the smaller of both, the other those of the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, need = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64)
            (syms, at), *ranks = [_lists(batch.column(k)) for k in (2, 3, 4)]
            row, i = _places(np.minimum(np.diff(at), need))
            cls = i % 3

            def rank(r, j):
                """1 + the rank of a sampled place, 0 beyond the end."""
                out, half = np.zeros(len(j), np.int64), j % 3
                for q in (1, 2):
                    mine = half == q
                    got, off = ranks[q - 1]
                    out[mine] = _at(got + 1, off, r[mine], j[mine] // 3)
                return out

            out = []
            for sort, kinds in enumerate([(0, 1), (2, 0), (1, 2)]):
                mine = (cls == kinds[0]) | (cls == kinds[1])
                r, j = row[mine], i[mine]
                first, zero = _at(syms, at, r, j), np.zeros(len(r), np.int64)
                keys = [(first, rank(r, j + 1), zero), (first, _at(syms, at, r, j + 1), rank(r, j + 2)), (rank(r, j), zero, zero)][sort]
                out.append((np.full(len(r), sort), *keys, (cls[mine] == kinds[1]).astype(np.int64), sid[r], j, need[r]))
            a, k0, k1, k2, kind, s, j, n = (np.concatenate(c) for c in zip(*out))
            yield _batch([c.split()[0] for c in _ROW.split(", ")], a.astype(np.int32), k0, k1, k2, kind.astype(np.int32), s, j.astype(np.int32), n.astype(np.int32))

    return strings.select("sid", "need", "syms", "r1", "r2").mapInArrow(run, _ROW)


def _packed(strings: DataFrame) -> DataFrame:
    """The half strings of strings of small symbols: a triple's name is its three symbols in one number."""
    third = F.col("syms")
    size = F.size(third)

    def half(q: int):
        def symbol(i, k):
            return F.coalesce(F.get(third, i + k), F.lit(0).cast("long"))

        places = F.when(size > q, F.sequence(F.lit(q), size - 1, F.lit(3))).otherwise(F.array().cast("array<int>"))
        names = F.transform(places, lambda i: symbol(i, 0) * PACKED * PACKED + symbol(i, 1) * PACKED + symbol(i, 2) + 1)
        wanted = F.floor(F.col("need") / 3) + 1 if q == 1 else F.floor((F.col("need") + 2) / 3)
        return strings.select((F.col("sid") * 2 + (q - 1)).alias("sid"), wanted.cast("int").alias("need"), names.alias("syms"))

    return half(1).unionByName(half(2)).where(F.size("syms") > 0)


def ranks(strings: DataFrame, depth: int, small: bool = False) -> DataFrame:
    """sid, r: for the first `need` suffixes of each string (sid, need, syms) their places in the order of all.

    Suffixes that differ in their first `depth` symbols are in the order of those; equal ones are next to
    each other. Symbols are 1 or more; under PACKED where `small`. Triples at places 1 and 2 modulo 3 are
    sorted and named, the strings of names ranked in turn to a third of the depth, and the classes merged
    by three sorts, in each of which two classes compare at once. Strings without a needed suffix are left out.
    """
    if depth <= 3:
        found = smaller(_triples(strings, True)).select("sid", "j", "need", F.col("less0").alias("v"))
        return saved(_strings(found, "r").select("sid", "r"))
    if small:
        halves = _packed(strings)
    else:
        halves = _strings(smaller(_triples(strings, False)).select("sid", "j", "need", (F.col("less0") + 1).alias("v")), "syms")
    below = ranks(saved(halves), -(-depth // 3))
    r1 = below.where(F.col("sid") % 2 == 0).select(F.shiftright("sid", 1).alias("sid"), F.col("r").alias("r1"))
    r2 = below.where(F.col("sid") % 2 == 1).select(F.shiftright("sid", 1).alias("sid"), F.col("r").alias("r2"))
    both = strings.join(r1.hint("shuffle_hash"), "sid", "left").join(r2.hint("shuffle_hash"), "sid", "left")
    found = smaller(_merged(both)).select("sid", "j", "need", F.when(F.col("kind") == 0, F.col("less0") + F.col("less1")).otherwise(F.col("less0")).alias("v"))
    return saved(_strings(found, "r").select("sid", "r"))


def repeated(strings: DataFrame, length: int) -> DataFrame:
    """sid, place: the needed suffixes whose first `length` symbols another needed suffix has too.

    Suffixes are put in their order and neighbours compared by a 64-bit hash of those symbols. A needed
    suffix must have that many symbols. Symbols are 1 or more and under PACKED.
    """
    placed = strings.join(ranks(strings, length, True).hint("shuffle_hash"), "sid")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            syms, at = _lists(batch.column(1))
            order, own = _lists(batch.column(2))
            power, inverse = _powers(1 << max(20, (len(syms) + 1).bit_length()))
            sums = np.zeros(len(syms) + 1, np.uint64)
            np.cumsum(mix(syms.astype(np.uint64)) * power[: len(syms)], out=sums[1:])
            row, i = _places(np.diff(own))
            low = at[row] + i
            digest = mix((sums[low + length] - sums[low]) * inverse[low]).view(np.int64)
            yield _batch(["sid", "place", "r", "digest"], np.asarray(batch.column(0), np.int64)[row], i.astype(np.int32), order, digest)

    suffixes = placed.select("sid", "syms", "r").mapInArrow(prefixes, "sid long, place int, r long, digest long")
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartitionByRange(parts, "r", "sid", "place").sortWithinPartitions("r", "sid", "place")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, begun = TaskContext.get().partitionId(), None, False

        def give(sid, place, same, digest, edge):
            return _batch(["sid", "place", "same", "digest", "edge", "part"], sid, place, same, digest, edge, np.full(len(sid), part, np.int32))

        for batch in batches:
            sid, place, digest = (np.asarray(batch.column(k)) for k in (0, 1, 3))
            same = np.zeros(len(sid), bool)
            if held is not None:
                sid, place, digest, same = (np.concatenate([h, x]) for h, x in zip(held, (sid, place, digest, same)))
            if not len(sid):
                continue
            equal = digest[1:] == digest[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            edge = np.zeros(len(sid), np.int32)
            if not begun:
                edge[0] = 1
            if len(sid) > 1:
                keep = same[:-1] | (edge[:-1] > 0)
                yield give(sid[:-1][keep], place[:-1][keep], same[:-1][keep], digest[:-1][keep], edge[:-1][keep])
                begun = True
            held = (sid[-1:], place[-1:], digest[-1:], same[-1:])
        if held is not None:
            yield give(held[0], held[1], held[3], held[2], np.array([2 if begun else 3], np.int32))

    found = saved(ordered.mapInArrow(neighbours, "sid long, place int, same boolean, digest long, edge int, part int"))
    edges = found.where("edge > 0").orderBy("part", "edge").collect()
    more = [(r["sid"], r["place"]) for a, b in zip(edges, edges[1:]) if a["part"] != b["part"] and a["digest"] == b["digest"] for r in (a, b)]
    here = found.where("same").select("sid", "place")
    return here.unionByName(strings.sparkSession.createDataFrame(more, "sid long, place int")).distinct()
