"""Near-duplicate documents by a chosen-path similarity join on word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import LOWER, SPACE, bounds, chunks, column_bytes, mix, ragged, span_hashes
from tidemark.llm._work import components, counted, hot_join, hot_keys, saved

#: Independent trees, and the most minwise tokens that a path of one chooses.
TREES, DEPTH = 16, 8
#: A path begins with so many tokens and takes STEP more at each large node; a node of at most LEAF members is compared exhaustively.
FIRST, STEP, LEAF = 2, 2, 12
#: Classes of a side of a block in large first nodes; fewer where they have more shingles than SHINGLES together.
WIDE, SHINGLES = 2048, 1 << 21
#: Hashings of a mark, and the parts of each: a mark has MARKS * BINS bits.
MARKS, BINS = 8, 256
#: The most documents that a broadcast names; texts of more are joined by a shuffle.
MOST_NAMED = 1_000_000

_rng = np.random.default_rng(20)
_FLIP, _TIMES = (_rng.integers(0, 1 << 63, (TREES * DEPTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_SEEDS = mix(np.arange(101, 101 + MARKS, dtype=np.uint64))[:, None]
_SLOTS = np.arange(MARKS * BINS, dtype=np.uint64) << np.uint64(64 - (MARKS * BINS).bit_length() + 1)
_SIGNS = mix(np.arange(1001, 1001 + MARKS * BINS, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes: `size` words in a row, the whole sequence where it is shorter."""
    part, at = LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    starts, ends = bounds(~SPACE[part], at)
    words = span_hashes(part, starts, ends)
    grams = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        grams += words[j : j + len(grams)] * _PLACE[j]
    grams = mix(grams)
    first = np.searchsorted(starts, at).tolist()
    for low, high in zip(first, first[1:]):
        n = high - low
        if n >= size:
            yield np.unique(grams[low : high - size + 1])
        elif n:
            yield mix(np.array([(words[low:high] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def minwise(values: np.ndarray) -> np.ndarray:
    """The TREES * DEPTH minwise tokens of a set of hashes."""
    out = np.full(len(_FLIP), 0xFFFFFFFF, np.uint64)
    for low in range(0, len(values), 4096):
        np.minimum(out, (((values[None, low : low + 4096] ^ _FLIP) * _TIMES) >> np.uint64(32)).min(1), out=out)
    return out.astype(np.uint32).view(np.int32)


def mark(values: np.ndarray) -> np.ndarray:
    """The bits of a set that is not empty: two sets of similarity s agree in a bit with probability (1 + s) / 2.

    Each hashing cuts its range into BINS bins; a bin has a bit of its least hash, an empty one of the
    next bin's.
    """
    tops = (np.arange(MARKS, dtype=np.uint64) << np.uint64(64 - MARKS.bit_length() + 1))[:, None]
    ordered = np.sort((tops | (mix(values[None, :] ^ _SEEDS) >> np.uint64(MARKS.bit_length() - 1))).ravel())
    at = np.searchsorted(ordered, _SLOTS)
    own = np.repeat(np.arange(MARKS), BINS)
    at = np.where(at >= (own + 1) * len(values), own * len(values), at)
    return np.packbits((mix(ordered[at] ^ _SIGNS) >> np.uint64(63)).astype(np.uint8))


def _node(values: np.ndarray) -> tuple[int, bytes]:
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), digest


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node (null: no words), tokens array<int>: documents with equal sets have the same node.

    A node is the low half of a 128-bit digest of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                counts, nodes, tokens = [], [], []
                for values in shingle_sets(data, offsets[i : j + 1], size):
                    counts.append(len(values))
                    nodes.append(_node(values)[0] if len(values) else None)
                    tokens.append(minwise(values))
                flat = pa.array(np.concatenate(tokens))
                cuts = pa.array(np.arange(j - i + 1, dtype=np.int32) * (TREES * DEPTH))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(cuts, flat)], ["doc_id", "n_shingles", "node", "tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, tokens array<int>")


def _keys() -> list[Column]:
    """The first node of a class in each tree."""
    return [F.xxhash64(F.lit(t), *(F.col("tokens")[t * DEPTH + k] for k in range(FIRST))) for t in range(TREES)]


def _paths(classes: DataFrame) -> DataFrame:
    """node, n_shingles, tree, key, rest: every class in every tree, at the node of its first FIRST tokens."""
    trees = F.array(*(F.struct(F.lit(t).alias("t"), key.alias("key"), F.slice("tokens", t * DEPTH + FIRST + 1, DEPTH - FIRST).alias("rest")) for t, key in enumerate(_keys())))
    return classes.select("node", "n_shingles", F.explode(trees).alias("tree")).select("node", "n_shingles", F.col("tree.t").alias("tree"), F.col("tree.key").alias("key"), F.col("tree.rest").alias("rest"))


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """a, b (a < b): pairs of classes that share a small node, or of which one is a pivot of a large node; and key, tree, node, n_shingles of the members of large first nodes.

    Small nodes give all their pairs, at most LEAF * (LEAF - 1) / 2. A large node gives pairs of each
    member with its smallest member (at the first level in a fourth of the nodes with one by hash too) and
    branches by the next tokens until it is small or the path is at its end; so the rows are linear in the
    members. Pairs whose sizes alone rule a link out are left out. Pairs that meet in large nodes only
    are left to `_crowded`.
    """
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    level, found, crowds = _paths(classes), [], None
    for depth in range(FIRST, DEPTH + 1, STEP):
        sizes = saved(level.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.min_by("node", F.xxhash64("node", "key")).alias("other")).where(F.col("n") > 1))
        level = saved(hot_join(level, sizes, "key", ["node"], hot_keys(sizes, "key")))
        small = level.where(F.col("n") <= LEAF).select("key", "node", "n_shingles")
        found.append(small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & fits(F.col("x.n_shingles"), F.col("y.n_shingles"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        large = level.where(F.col("n") > LEAF)
        crowds = large.select("key", "tree", "node", "n_shingles") if crowds is None else crowds
        other = F.when((F.pmod("key", F.lit(4)) == 0) & F.lit(depth == FIRST), F.col("other"))
        star = large.select("node", F.explode(F.array_compact(F.array("low", other))).alias("pivot")).where(F.col("node") != F.col("pivot"))
        found.append(star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
        if depth + STEP > DEPTH or large.isEmpty():
            break
        level = large.select("node", "n_shingles", "tree", F.xxhash64("key", *(F.col("rest")[k] for k in range(STEP))).alias("key"), F.slice("rest", STEP + 1, DEPTH).alias("rest"))
    return saved(reduce(DataFrame.unionByName, found).distinct()), crowds


def _sets(wanted: DataFrame, docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """node, items, bits: the full sets of the classes in `wanted` (node, marked), made again from one document of each; the marks of those marked.

    Up to MOST_NAMED documents are named by a broadcast; more move their texts, and only theirs.
    A repeated row may give its set once in each task.
    """
    first = rows.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = saved(first.join(wanted, "node").groupBy("doc_id").agg(F.max("marked").alias("marked"), F.collect_set("node").alias("nodes")))
    ids = F.broadcast(ids) if ids.count() <= MOST_NAMED else ids.hint("shuffle_hash")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(ids, "doc_id").select("text", "marked", "nodes")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for i, j in chunks(offsets):
                nodes, sets, bits = [], [], []
                for k, values in enumerate(shingle_sets(data, offsets[i : j + 1], size), i):
                    node = _node(values)[0] if len(values) else None
                    if node is not None and node not in seen and node in batch.column(2)[k].as_py():
                        seen.add(node)
                        nodes.append(node)
                        sets.append(values.tobytes())
                        bits.append(mark(values).tobytes() if batch.column(1)[k].as_py() else None)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bits, pa.binary())], ["node", "items", "bits"])

    return saved(texts.mapInArrow(make, "node long, items binary, bits binary"))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked on full sets. A class may be in any number of them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in both), percent) for both in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda name, items: sets.select(F.col("node").alias(name), F.col("items").alias(items))
    hot = [hot_keys(counted(pairs, name), name) for name in ("a", "b")]
    joined = hot_join(hot_join(pairs, of("a", "x"), "a", ["b"], hot[0]), of("b", "y"), "b", ["a"], hot[1])
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """The estimate that marks of linked sets reach: six standard deviations below the threshold.

    The marks of sets of n shingles stand for no more than n of them in each hashing.
    """
    p = percent / 100
    spread = 2 * p * (1 - p) / (MARKS * np.minimum(p * n, BINS)) + (1 - p) / (MARKS * BINS)
    return p - 6 * np.sqrt(spread)


def mates(cell: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of both sides of a block that may be linked with one of the other side, a few rows at a time.

    Pairs of one component, of sizes or marks too far apart, and those that meet in the first node of
    an earlier tree are left out.
    """
    x, y = _sides(cell)
    if x.empty or y.empty:
        return
    signs = [np.unpackbits(np.frombuffer(b"".join(d["bits"]), np.uint8).reshape(len(d), -1), axis=1).astype(np.float32) * 2 - 1 for d in (x, y)]
    keys = [np.stack(d["keys"].to_numpy()) for d in (x, y)]
    (node_x, comp_x, n_x), (node_y, comp_y, n_y) = (d[["node", "comp", "n_shingles"]].to_numpy().T for d in (x, y))
    least, tree = _least(n_x, percent), cell["tree"].iloc[0]
    for low in range(0, len(x), 256):
        part = slice(low, low + 256)
        fit = (signs[0][part] @ signs[1].T / np.float32(MARKS * BINS) >= least[part, None]) & (comp_x[part, None] != comp_y[None, :])
        fit &= 100 * np.minimum(n_x[part, None], n_y[None, :]) >= percent * np.maximum(n_x[part, None], n_y[None, :])
        one, other = np.nonzero(fit)
        for k in range(0, len(one), 1 << 16):
            a, b = one[k : k + (1 << 16)] + low, other[k : k + (1 << 16)]
            new = (keys[0][a] == keys[1][b]).argmax(1) == tree
            yield node_x[np.unique(a[new])], node_y[np.unique(b[new])]


def _sides(cell: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Both sides of a block; a block on the diagonal has one, which stands on both."""
    x, y = (cell[cell["side"] == k].drop_duplicates("node").reset_index(drop=True) for k in (0, 1))
    return (x, x) if cell["i"].iloc[0] == cell["j"].iloc[0] else (x, y)


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many values each of the sets `xs` has in common with each of `ys`.

    Values that many of `ys` hold are counted by products of 0-1 matrices, `columns` values at a time;
    each pair of holders of a rarer value by itself.
    """
    rows = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (xs, ys)]
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (xs, ys)]
    common = np.intersect1d(*flat)
    held = []
    for owner, values in zip(rows, flat):
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        own = common[at] == values if len(common) else np.zeros(len(values), bool)
        order = np.argsort(at[own], kind="stable")
        held.append((owner[own][order], at[own][order]))
    (row_x, col_x), (row_y, col_y) = held
    out = np.zeros((len(xs), len(ys)), np.float32)
    many = np.bincount(col_y, minlength=len(common))
    dense = many * 16 > len(ys)
    number = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), columns):
        parts = []
        for owner, col, n in ((row_x, col_x, len(xs)), (row_y, col_y, len(ys))):
            own = dense[col] & (number[col] >= low) & (number[col] < low + columns)
            part = np.zeros((n, columns), np.float32)
            part[owner[own], number[col[own]] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    first = np.cumsum(many) - many
    rare = np.flatnonzero(~dense[col_x])
    for low in range(0, len(rare), 4096):
        part = rare[low : low + 4096]
        n = many[col_x[part]]
        if n.sum():
            np.add.at(out, (np.repeat(row_x[part], n), row_y[ragged(first[col_x[part]], n)]), 1)
    return out


def _crowded(links: DataFrame, crowds: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """More links, between members of a large first node that are still in different components.

    All such pairs are compared, each in the first tree where it meets: members outside of the node's
    largest component with each other and with that component, in blocks of WIDE by WIDE classes (fewer
    where sets are large). Marks of MARKS * BINS bits find the members that may have a partner; only the
    sets of these move, and are counted exactly. Only links leave a task, at most one for each member. A member's marks are
    copied once for each WIDE members of its node.
    """
    own = saved(crowds.join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    parts = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    most = F.max(F.struct("n", "comp", "size")).alias("most")
    whole = saved(parts.groupBy("key").agg(most, F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("n") > F.col("most.n")))
    if whole.isEmpty():
        return links
    blocks = lambda n, size: F.greatest(F.ceil(n / WIDE), F.ceil(size / SHINGLES))
    grid = whole.select("key", F.col("most.comp").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("rows"), blocks(F.col("most.n"), F.col("most.size")).alias("columns"))
    inside = F.col("comp") == F.col("main")
    at = F.when(inside, F.col("rows") + F.pmod(F.xxhash64("node"), F.col("columns"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rows")))
    placed = hot_join(own, grid, "key", ["node"], hot_keys(whole, "key")).select("key", "tree", "node", "comp", "rows", (F.col("rows") + F.col("columns")).alias("all"), inside.alias("inside"), at.alias("at"))
    up = F.when(~F.col("inside"), F.transform(F.sequence("at", F.col("all") - 1), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    down = F.when(F.col("at") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.least("at", "rows") - 1), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"))))
    cells = placed.select("key", "tree", "node", "comp", F.explode(F.flatten(F.array_compact(F.array(up, down)))).alias("cell")).select("key", "tree", "node", "comp", "cell.*")
    marks = sets.where(F.col("bits").isNotNull()).select("node", "bits").dropDuplicates(["node"])
    cells = cells.join(marks.join(classes.select("node", "n_shingles", F.array(*(k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for k in _keys())).alias("keys")), "node"), "node")

    def meet(cell: pd.DataFrame) -> pd.DataFrame:
        wanted: set[int] = set()
        for one, other in mates(cell, percent):
            wanted.update(one.tolist(), other.tolist())
        return cell[cell["node"].isin(wanted)]

    likely = saved(cells.groupBy("key", "i", "j").applyInPandas(meet, cells.schema))
    if likely.isEmpty():
        return links

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        x, y = _sides(cell)
        root, out = {c: c for c in cell["comp"]}, []

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        if len(x) and len(y):
            sets = [[np.frombuffer(v, np.uint64) for v in d["items"]] for d in (x, y)]
            n_x, n_y = (np.array([len(v) for v in s]) for s in sets)
            both = overlaps(*sets)
            linked = (100 * both >= percent * (n_x[:, None] + n_y[None, :] - both)) & (x["comp"].to_numpy()[:, None] != y["comp"].to_numpy()[None, :])
            for i, j in zip(*(k.tolist() for k in np.nonzero(linked))):
                a, b = top(int(x["comp"].iat[i])), top(int(y["comp"].iat[j]))
                if a != b:
                    root[a] = b
                    out.append(tuple(sorted((x["node"].iat[i], y["node"].iat[j]))))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    new = likely.join(sets.select("node", "items"), "node").groupBy("key", "i", "j").applyInPandas(search, "a long, b long")
    return saved(links.unionByName(new))


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked by Jaccard similarity of their shingle sets.

    Equal sets are one class and need no join. Classes meet in TREES independent trees: a path chooses
    FIRST tokens, then STEP more at each large node, so two sets of similarity s meet in a node of d tokens
    of one tree with probability s ** d; with all trees a pair at the threshold is missed less than once
    in a million. Links are confirmed on full sets: first each class with its smallest candidate, then
    the pairs that are still in different components, then all pairs of large first nodes that are still
    in different components.

    component_id is the smallest doc_id reachable. Texts without words (null too) are linked with nothing.
    Rows with a null doc_id are not linked: component_id is null and kept is true. Repeated rows have the
    same component and the same kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = saved(sketches(docs, size))
    named = rows.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = named.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.max("tokens").alias("tokens"))
    pairs, crowds = candidates(classes, percent)
    crowd = crowds.select("node", F.lit(True).alias("marked"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(False).alias("marked")).unionByName(crowd).groupBy("node").agg(F.max("marked").alias("marked"))
    sets = _sets(wanted, docs, rows, size)
    nearest = saved(pairs.groupBy("b").agg(F.min("a").alias("a")))
    links = saved(confirmed(nearest, sets, percent))
    if not pairs.isEmpty():
        comp = components(links)
        of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        hot = [hot_keys(counted(pairs, name), name) for name in ("a", "b")]
        rest = pairs.join(nearest, ["a", "b"], "left_anti")
        rest = hot_join(hot_join(rest, of("a"), "a", ["b"], hot[0], "left"), of("b"), "b", ["a"], hot[1], "left")
        rest = saved(rest.where(F.coalesce(F.col("a_comp") != F.col("b_comp"), F.lit(True))).select("a", "b"))
        if not rest.isEmpty():
            links = saved(links.unionByName(confirmed(rest, sets, percent)))
        if not crowds.isEmpty():
            links = _crowded(links, crowds, classes, sets, percent)
    comp = components(links)
    smallest = named.groupBy("node").agg(F.min("doc_id").alias("low"))
    smallest = smallest.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = smallest.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_node = smallest.join(of_comp, "comp").select("node", "component_id")
    joined = rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
