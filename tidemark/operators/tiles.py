"""Joins of token sets by tiles: a task holds the rows of two parts of a block, and only pairs that reach the similarity leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import saved

#: A part has about TILE tokens at most, which bounds a task's memory; smaller cells have up to SPLIT parts of LEAST_TILE tokens or more.
TILE, SPLIT, LEAST_TILE = 8_000_000, 8, 200_000
#: Sets are counted against DENSE tokens by a product, MOST_ROWS at a time at most, and by MOST_HITS lists' rows or those of one set.
DENSE, MOST_ROWS, MOST_HITS = 512, 64, 2_000_000
#: The COMMON most frequent tokens of a table are coded by two bytes each. Parts of coded rows have
#: about CODED times TILE tokens at most; a row counts as ROW tokens more.
COMMON, CODED, ROW = 65_536, 4, 200
#: Coded rows have the tile's HELD most frequent tokens as bits; they are counted against WIDTH rows at a time, PAIRS pairs together, and leave by batches of PAIRS.
HELD, WIDTH, PAIRS = 2048, 2048, 1 << 18
#: The role of rows whose part meets itself; those of a tile of two parts have 0 and 1.
OWN = 2


def tiled(rows: DataFrame, blocks: Sequence[str], apart: Sequence[int], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`run` on each tile of `rows` (blocks, id, t, cell and others): two parts of cells of one block that are so far apart.

    In a tile's rows `_role` is 0 for the part of the smaller cell and 1 for the other; a part that meets itself has 0 only.
    A row is copied once for each part that its part meets. Rows with a null key or id meet nothing.
    """
    whole = rows.dropna(subset=[*blocks, "id", "cell"]).where(F.size("t") > 0)
    size = F.sum(F.size("t").cast("long"))
    parts = F.greatest(F.ceil(size / TILE), F.least(F.ceil(size / LEAST_TILE), F.lit(SPLIT)))
    cells = saved(whole.groupBy(*blocks, "cell").agg(parts.cast("int").alias("_parts")))
    placed = whole.join(cells, [*blocks, "cell"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    out = None
    for k in apart:
        other = lambda by: cells.select(*blocks, (F.col("cell") + by).alias("cell"), "_parts")
        tile = lambda cell, p, q, role: (cell.cast("long").alias("_c"), F.lit(k).alias("_k"), p.alias("_p"), q.alias("_q"), F.lit(role).alias("_role"))  # noqa: E731, B023
        cell, part, n = F.col("cell"), F.col("_part"), F.col("_parts")
        ahead, behind = placed.join(other(-k), [*blocks, "cell"]), placed.join(other(k), [*blocks, "cell"])
        first = ahead.withColumn("_o", F.explode(F.sequence(part if k == 0 else F.lit(0), n - 1)))
        second = behind.where(part > 0) if k == 0 else behind
        second = second.withColumn("_o", F.explode(F.sequence(F.lit(0), (part if k == 0 else n) - 1)))
        for d in (first.select(*rows.columns, *tile(cell, part, F.col("_o"), 0)), second.select(*rows.columns, *tile(cell - k, F.col("_o"), part, 1))):
            out = d if out is None else out.unionByName(d)
    return out.groupBy(*blocks, "_c", "_k", "_p", "_q").applyInPandas(run, schema)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of all ranges one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Counts:
    """Token sets that others are counted against: the DENSE most frequent tokens as columns of a matrix, the rest as lists of rows."""

    def __init__(self, sets: Sequence[np.ndarray]):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.known, ids = np.unique(np.concatenate(list(sets)), return_inverse=True)
        ids = ids.astype(np.int32)
        times = np.bincount(ids, minlength=len(self.known))
        often = np.argsort(-times, kind="stable")[:DENSE]
        self.column = np.full(len(times), -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        rows = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        held = self.column[ids] >= 0
        self.matrix = np.zeros((len(often), len(sets)), dtype=np.float32)
        self.matrix[self.column[ids[held]], rows[held]] = 1
        rows, ids = rows[~held], ids[~held]
        self.rows = rows[np.argsort(ids, kind="stable")]
        times[often] = 0
        self.at = np.concatenate([[0], np.cumsum(times)])

    def shared(self, sets: Sequence[np.ndarray]):
        """The first of some of `sets` and how many tokens each of these has in common with each set here, until all are told."""
        first = 0
        while first < len(sets):
            some = sets[first : first + MOST_ROWS]
            sizes = np.array([len(s) for s in some])
            token = np.concatenate(list(some))
            at = np.minimum(np.searchsorted(self.known, token), len(self.known) - 1)
            met = self.known[at] == token
            row, at = np.repeat(np.arange(len(some)), sizes)[met], at[met]
            hits = self.at[at + 1] - self.at[at]
            take = max(1, int(np.searchsorted(np.cumsum(np.bincount(row, hits, len(some))), MOST_HITS, side="right")))
            row, at, hits = row[row < take], at[row < take], hits[row < take]
            take = min(take, len(some))
            held = self.column[at] >= 0
            mine = np.zeros((take, len(self.matrix)), dtype=np.float32)
            mine[row[held], self.column[at[held]]] = 1
            both = mine @ self.matrix
            cells = np.repeat(row * len(self.n), hits) + self.rows[_spread(self.at[at], hits)]
            yield first, both + np.bincount(cells, minlength=both.size).reshape(both.shape)
            first += take


def best_of(tile: pd.DataFrame, blocks: Sequence[str], least: float) -> pd.DataFrame:
    """blocks, left_id, right_id, similarity: the best of the second role for each row of the first, of equal ones the largest id.

    At a low threshold nearly all rows of a block share a token, so all are counted, many rows together.
    """
    rows = tile.sort_values(["_role", "id"], ascending=[True, False], ignore_index=True)
    split = int((rows["_role"] == 0).sum())
    out = []
    if 0 < split < len(rows):
        lefts, rights = rows["t"].to_list()[:split], Counts(rows["t"].to_list()[split:])
        for first, both in rights.shared(lefts):
            n = np.array([len(s) for s in lefts[first : first + len(both)]])
            ratio = both / (n[:, None] + rights.n - both)
            j = ratio.argmax(axis=1)
            best = ratio[np.arange(len(j)), j]
            out += [(first + i, split + j[i], best[i]) for i in np.flatnonzero(best >= least)]
    return _named(rows, blocks, out)


def _named(rows: pd.DataFrame, blocks: Sequence[str], found: list[tuple]) -> pd.DataFrame:
    i, j, r = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
    ids = rows["id"].to_numpy()
    return pd.DataFrame({**{b: pd.Series([rows[b].iloc[0]] * len(i), dtype=object) for b in blocks}, "left_id": ids[i], "right_id": ids[j], "similarity": r.astype(float)})


def coded(sets: DataFrame, kept: Sequence[str]) -> DataFrame:
    """`kept`, n, c, r of rows with token sets t: how many tokens, the common ones by their frequency's rank (less 32768), the rest.

    Which tokens are common changes the size of the rows only: any other is kept as it is.
    """
    times = sets.select(F.explode_outer("t").alias("token")).groupBy("token").agg(F.count("token").alias("f")).where("f > 1")
    tokens = np.array([x.token for x in times.orderBy(F.desc("f"), "token").limit(COMMON).collect()], dtype=np.int64)
    order = np.argsort(tokens)
    known, rank = tokens[order], order.astype(np.int32)
    kind = dict(sets.dtypes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("t")), 0))
            lists = batch.column("t")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
            met = known[at] == token if len(known) else np.zeros(len(token), dtype=bool)
            c = np.sort(row[met] * COMMON + rank[at[met]])
            r = np.lexsort((token[~met], row[~met]))
            lists = lambda rows, values, t: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(n)))]).astype(np.int32)), pa.array(values, t))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(n.astype(np.int32)), lists(c // COMMON, (c % COMMON - 32768).astype(np.int16), pa.int16()), lists(row[~met][r], token[~met][r], pa.int64())], [*kept, "n", "c", "r"])

    return sets.mapInArrow(code, ", ".join([*(f"`{k}` {kind[k]}" for k in kept), "n int, c array<smallint>, r array<bigint>"]))


def by_size(rows: DataFrame, blocks: Sequence[str], least: float) -> tuple[DataFrame, DataFrame]:
    """`rows` (blocks, id, cell, n and others) with `_g`, `_p`, and the tiles: blocks, _tile, _g, _p, _h, _q.

    `_g` is a run of a block's cells, `_p` a part of its rows by their size n, both with about CODED * TILE tokens at most; rows of one size
    are dealt by their id. Parts make a tile where sizes of theirs can have the similarity `least` and cells are the same or next.
    """
    most, held = CODED * TILE, [*blocks, "_g"]
    sizes = rows.groupBy(*blocks, "cell", "n").agg((F.count(F.lit(1)) * (F.col("n") + ROW)).alias("w"))
    ordered = lambda by, order, *ends: F.coalesce(F.sum("w").over(Window.partitionBy(*by).orderBy(order).rangeBetween(*ends)), F.lit(0))
    whole = Window.partitionBy(*held)
    places = sizes.withColumn("_g", F.floor(ordered(blocks, "cell", Window.unboundedPreceding, -1) / most))
    places = places.withColumns({"_first": ordered(held, "n", Window.unboundedPreceding, -1), "_same": ordered(held, "n", 0, 0), "_all": F.sum("w").over(whole), "first_cell": F.min("cell").over(whole), "last_cell": F.max("cell").over(whole)})
    places = saved(places.drop("w"))
    parts = F.ceil(F.col("_all") / most)
    part = lambda share: F.least(parts - 1, F.floor((F.col("_first") + share * F.col("_same")) * parts / F.col("_all"))).cast("int")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    placed = rows.join(places.drop("first_cell", "last_cell"), [*blocks, "cell", "n"]).withColumn("_p", part(share)).drop("_first", "_same", "_all")
    there = places.withColumn("_p", F.explode(F.sequence(part(F.lit(0)), part(F.lit(1)))))
    there = there.groupBy(*held, "first_cell", "last_cell", "_p").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    names = {"_g": "_h", "_p": "_q", **{c: f"_{c}" for c in ("least_n", "most_n", "first_cell", "last_cell")}}
    other = there.select(*blocks, *(F.col(c).alias(d) for c, d in names.items()))
    after = (F.col("_g") == F.col("_h")) & (F.col("_p") <= F.col("_q")) | (F.col("_g") < F.col("_h")) & (F.col("_first_cell") <= F.col("last_cell") + 1)
    fits = (F.col("most_n") >= least * F.col("_least_n") - 1e-9) & (F.col("_most_n") >= least * F.col("least_n") - 1e-9)
    tiles = there.join(other, [*blocks]).where(after & fits).select(*blocks, "_g", "_p", "_h", "_q", F.monotonically_increasing_id().alias("_tile"))
    return placed, saved(tiles)


def same_sets(rows: DataFrame, blocks: Sequence[str], least: float, days: int, schema: str) -> DataFrame:
    """blocks, left_id, right_id, similarity: pairs of coded `rows` (blocks, id, number, cell) within `days` that have the similarity, the smaller id first.

    A row is copied once for each part that its part meets.
    """
    placed, tiles = by_size(rows, blocks, least)
    alone = (F.col("_g") == F.col("_h")) & (F.col("_p") == F.col("_q"))
    one = lambda g, p, role: tiles.select(*blocks, F.col(g).alias("_g"), F.col(p).alias("_p"), F.struct("_tile", role.alias("_role")).alias("_at")).where("_at._role is not null")
    targets = one("_g", "_p", F.when(alone, OWN).otherwise(0)).unionByName(one("_h", "_q", F.when(~alone, 1))).groupBy(*blocks, "_g", "_p").agg(F.collect_list("_at").alias("_at"))
    copies = placed.join(targets, [*blocks, "_g", "_p"]).withColumn("_at", F.explode("_at")).select("_at._tile", "_at._role", *blocks, "id", "number", "n", "c", "r")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tiles.count() // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs_of(pa.Table.from_batches(list(batches)), blocks, least, days)

    return copies.repartition(n, "_tile").groupBy("_tile").applyInArrow(run, schema)


def _lists(tile: pa.Table, name: str, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the lists of a column begin, their sizes, both in this order, and their values as they are."""
    lists = tile.column(name).combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.cumsum(sizes) - sizes)[order], sizes[order], lists.flatten().to_numpy()


class Coded:
    """The coded sets of a tile in a given order: `token` and `at` have those that are counted by lists, `bits` the HELD most frequent, `held` how many of these."""

    def __init__(self, tile: pa.Table, order: np.ndarray):
        self.n = tile.column("n").to_numpy().astype(np.int64)[order]
        starts, sizes, c = _lists(tile, "c", order)
        steps = range(0, len(order), WIDTH)
        times = np.zeros(COMMON, dtype=np.int64)
        for first in range(0, len(c), PAIRS):
            times += np.bincount(c[first : first + PAIRS].astype(np.int64) + 32768, minlength=COMMON)
        often = np.argsort(-times, kind="stable")[:HELD]
        bit = np.full(COMMON, -1, dtype=np.int32)
        bit[often] = np.arange(len(often))
        other, rest = self._rest(tile, order)
        self.known = COMMON + (int(rest.max()) + 1 if len(rest) else 0)
        ends = np.concatenate([[0], np.cumsum(np.bincount(other, minlength=len(order)))])
        self.bits = np.empty((len(order), HELD // 64), dtype=np.uint64)
        tokens, counts, held = [], [], []
        for first in steps:
            own = slice(first, first + WIDTH)
            token = c[_spread(starts[own], sizes[own])].astype(np.int32) + 32768
            row, at = np.repeat(np.arange(len(sizes[own])), sizes[own]), bit[token]
            some = np.zeros((len(sizes[own]), HELD), dtype=bool)
            some[row[at >= 0], at[at >= 0]] = True
            self.bits[own] = np.packbits(some, axis=1).view(np.uint64)
            held.append(some.sum(axis=1))
            more = slice(ends[first], ends[min(first + WIDTH, len(order))])
            row, token = np.concatenate([row[at < 0], other[more] - first]), np.concatenate([token[at < 0], rest[more] + COMMON])
            tokens.append(token[np.argsort(row, kind="stable")])
            counts.append(np.bincount(row, minlength=len(some)))
        self.held, self.token = np.concatenate(held), np.concatenate(tokens)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    @staticmethod
    def _rest(tile: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the tokens without a code that several rows have."""
        starts, sizes, r = _lists(tile, "r", order)
        _, number, times = np.unique(r[_spread(starts, sizes)], return_inverse=True, return_counts=True)
        more = times[number] > 1
        return np.repeat(np.arange(len(order)), sizes)[more], (np.cumsum(times > 1) - 1).astype(np.int32)[number[more]]

    def lists(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows from `first` to `end`: for each token where its list begins, and the rows, counted from `first`."""
        token = self.token[self.at[first] : self.at[end]]
        row = np.repeat(np.arange(end - first), self.at[first + 1 : end + 1] - self.at[first:end])
        rows = np.sort(token.astype(np.int64) * WIDTH + row) % WIDTH
        return np.concatenate([[0], np.cumsum(np.bincount(token, minlength=self.known))]), rows


def _shared(sets: Coded, i: int, end: int, lists: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """How many of its listed tokens each row from `i` to `end` has in common with each of `width` rows of the lists, one row after the other."""
    at, rows = lists
    token = sets.token[sets.at[i] : sets.at[end]]
    hits = at[token + 1] - at[token]
    some = np.flatnonzero(hits)
    base = np.repeat(np.arange(end - i) * width, sets.at[i + 1 : end + 1] - sets.at[i:end])[some]
    token, hits = token[some], hits[some]
    both, piece = None, np.cumsum(hits) // MOST_HITS
    for k in np.unique(piece):
        a, b = np.searchsorted(piece, [k, k + 1])
        cell = rows[_spread(at[token[a:b]], hits[a:b])]
        cell += np.repeat(base[a:b], hits[a:b])
        found = np.bincount(cell, minlength=(end - i) * width)
        both = found if both is None else both + found
    return np.zeros((end - i) * width, dtype=np.int64) if both is None else both


def pairs_of(tile: pa.Table, blocks: Sequence[str], least: float, days: int) -> Iterator[pa.RecordBatch]:
    """blocks, left_id, right_id, similarity: the pairs within `days` that have the similarity, the smaller id first.

    Two such sets share `need` tokens. Of the HELD most frequent no more are shared than the smaller number of them, so only pairs
    that share enough of the others, which are counted by lists, are counted in full.
    """
    n, role = tile.column("n").to_numpy(), tile.column("_role").to_numpy()
    order = np.lexsort((n, role))
    split, own = int((role != 1).sum()), role[0] == OWN
    if not own and split in (0, len(order)):
        return
    sets, day = Coded(tile, order), tile.column("number").to_numpy()[order].astype(np.int64)
    ids = tile.column("id").take(pa.array(order)).combine_chunks()
    name = ids.to_numpy(zero_copy_only=False)
    part, kept = least / (1 + least), []
    need = np.floor(part * sets.n - sets.held / 2 - 1e-9).astype(np.int64)

    def batch() -> pa.RecordBatch:
        i, j, ratio = (np.concatenate(x) for x in zip(*kept))
        kept.clear()
        small = name[i] < name[j]
        left, right = np.where(small, i, j), np.where(small, j, i)
        block = pa.array(np.zeros(len(i), dtype=np.int64))
        return pa.RecordBatch.from_arrays([*(tile.column(b).slice(0, 1).combine_chunks().take(block) for b in blocks), ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(ratio)], [*blocks, "left_id", "right_id", "similarity"])

    for first in range(0 if own else split, len(order), WIDTH):
        end = min(first + WIDTH, len(order))
        width, lists = end - first, sets.lists(first, end)
        top = end if own else split
        i, last = np.searchsorted(sets.n[:top], [np.ceil(least * sets.n[first] - 1e-9), np.floor(sets.n[end - 1] / least + 1e-9) + 1])
        while i < last:
            upto = min(last, i + max(1, PAIRS // width))
            both = _shared(sets, i, upto, lists, width)
            lacks = both.reshape(-1, width)
            lacks -= need[first:end]
            at = np.flatnonzero(lacks >= need[i:upto, None])
            a, b = i + at // width, first + at % width
            both = both[at] + need[b]
            fits = (both + np.minimum(sets.held[a], sets.held[b]) >= part * (sets.n[a] + sets.n[b]) - 1e-9) & (np.abs(day[a] - day[b]) <= days)
            if own:
                fits &= a < b
            at = np.flatnonzero(fits)
            for k in range(0, len(at), PAIRS // 16):
                x, y = a[at[k : k + PAIRS // 16]], b[at[k : k + PAIRS // 16]]
                shared = both[at[k : k + PAIRS // 16]] + np.bitwise_count(sets.bits[x] & sets.bits[y]).sum(axis=1, dtype=np.int64)
                ratio = shared / (sets.n[x] + sets.n[y] - shared)
                good = (ratio >= least) & (name[x] != name[y])
                kept.append((x[good], y[good], ratio[good]))
                if sum(len(r) for _, _, r in kept) >= PAIRS:
                    yield batch()
            i = upto
    if kept:
        yield batch()
