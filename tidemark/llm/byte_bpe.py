"""Byte-level byte-pair encoding and decoding by segment trees over byte positions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._pieces import IdTable, Words, spaced_pieces
from tidemark.llm._text import CHUNK_BYTES, SPACE, column_bytes, ragged

_NONE = np.iinfo(np.int32).max
#: Pieces of up to LONGEST bytes are merged together, a tree each; a longer one by itself.
LONGEST = 64
#: Bytes of pieces that are merged at a time.
FOREST_BYTES = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank on each line. Ranks are ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class SegmentTree:
    """The pair ranks of one piece by byte position; each node holds the least rank below it.

    A position that starts no pair has the rank _NONE. `first` goes down to the leftmost position of the
    least rank, `put` changes one position; both take steps as the logarithm of the length.
    """

    def __init__(self, ranks: list[int]):
        self.half = 1 << max(0, (len(ranks) - 1).bit_length())
        self.node = [_NONE] * self.half + ranks + [_NONE] * (self.half - len(ranks))
        for i in range(self.half - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def least(self) -> int:
        return self.node[1]

    def first(self) -> int:
        i, node = 1, self.node
        while i < self.half:
            i = 2 * i if node[2 * i] == node[i] else 2 * i + 1
        return i - self.half

    def put(self, at: int, rank: int) -> None:
        i, node = at + self.half, self.node
        node[i] = rank
        while i > 1:
            i >>= 1
            low = min(node[2 * i], node[2 * i + 1])
            if node[i] == low:
                break
            node[i] = low


class Merger:
    """Merges pieces with the ranks of a vocabulary in which every byte is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 2
        pairs = {ranks[t[:k]] * self.width + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(self.keys)
        self.keys, self.made = np.append(self.keys[order], np.iinfo(np.int64).max), np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], _NONE)
        self.pair = pairs

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; _NONE where a pair is no token."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], np.int32(_NONE))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece, whatever its length: time grows as length times its logarithm."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        n, width, pair = len(ids), self.width, self.pair
        tree = SegmentTree([*self.rank(ids[:-1], ids[1:]).tolist(), _NONE])
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while (rank := tree.least()) != _NONE:
            at = tree.first()
            gone = after[at]
            beyond, back = after[gone], before[at]
            ids[at], ids[gone], after[at] = rank, -1, beyond
            tree.put(gone, _NONE)
            if beyond < n:
                before[beyond] = at
            tree.put(at, pair.get(rank * width + ids[beyond], _NONE) if beyond < n else _NONE)
            if back >= 0:
                tree.put(back, pair.get(ids[back] * width + rank, _NONE))
        return [i for i in ids if i >= 0]

    def merge_all(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pieces of up to `half` bytes (a power of two), and how many each has.

        The trees stand side by side. In each round every piece that has a pair left merges its leftmost
        least one; the leaf of the pair, of the token that is gone and of the neighbour before change, and
        their nodes up to the root follow.
        """
        k, levels = len(starts), half.bit_length() - 1
        inside = np.arange(half) < sizes[:, None]
        ids = np.full((k, half + 1), self.width - 1, np.int64)
        ids[:, :half][inside] = self.byte[raw[ragged(starts, sizes)]]
        after = np.where(np.arange(1, half + 1) < sizes[:, None], np.arange(1, half + 1), half).astype(np.int64)
        before = np.tile(np.arange(-1, half, dtype=np.int64), (k, 1))
        tree = np.full((k, 2 * half), _NONE, np.int32)
        tree[:, half:] = self.rank(ids[:, :-1], ids[:, 1:])
        for level in range(levels):
            low = half >> (level + 1)
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        lives = inside.copy()
        nodes, flat_ids, flat_after, flat_before, flat_lives = tree.reshape(-1), ids.reshape(-1), after.reshape(-1), before.reshape(-1), lives.reshape(-1)
        row = np.arange(k)
        while True:
            row = row[nodes[row * 2 * half + 1] != _NONE]
            if not len(row):
                break
            root, wide, narrow = row * 2 * half, row * (half + 1), row * half
            made, at = nodes[root + 1], np.ones(len(row), np.int64)
            for _ in range(levels):
                at = 2 * at + (nodes[root + 2 * at] != made)
            at -= half
            gone, back = flat_after[narrow + at], flat_before[wide + at]
            beyond = flat_after[narrow + gone]
            flat_ids[wide + at], flat_after[narrow + at], flat_lives[narrow + gone] = made, beyond, False
            flat_before[wide + beyond] = at
            head = back < 0
            nodes[root + half + gone] = _NONE
            nodes[root + half + at] = self.rank(made.astype(np.int64), flat_ids[wide + beyond])
            back = np.where(head, at, back)
            nodes[root + half + back] = np.where(head, nodes[root + half + at], self.rank(flat_ids[wide + back], made.astype(np.int64)))
            node = half + np.concatenate([gone, at, back])
            root = np.concatenate([root, root, root])
            for _ in range(levels):
                node >>= 1
                nodes[root + node] = np.minimum(nodes[root + 2 * node], nodes[root + 2 * node + 1])
        return ids[:, :half][lives], lives.sum(axis=1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has; a piece that is a token is its id."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts, parts = np.ones(len(pieces), np.int64), []
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        parts.append((np.flatnonzero(whole >= 0), whole[whole >= 0]))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(sizes) - sizes
        low = 1
        while low < LONGEST:
            chosen = np.flatnonzero((whole < 0) & (sizes > low) & (sizes <= 2 * low))
            low *= 2
            step = FOREST_BYTES // low
            for i in range(0, len(chosen), step):
                some = chosen[i : i + step]
                ids, counts[some] = self.merge_all(raw, starts[some], sizes[some], low)
                parts.append((some, ids))
        for i in np.flatnonzero((whole < 0) & (sizes > LONGEST)).tolist():
            ids = np.array(self.merge(pieces[i]), np.int64)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        out, upto = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for some, ids in parts:
            out[ragged(upto[some], counts[some])] = ids
        return out, counts


def segments(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows cut into segments of about `limit` bytes, several short rows or a part of one at a time: (rows, offsets).

    A row is cut only before an ASCII space that follows a printed ASCII sign, which no piece spans; one
    without such a place is not cut.
    """
    rows, cuts, size = [], [int(offsets[0])], 0
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while high - low > limit:
            at, found = low + limit, None
            while found is None and at < high:
                part = data[at : min(at + 4096, high)]
                before = data[at - 1 : at - 1 + len(part)]
                good = np.flatnonzero((part == 32) & (before > 32) & (before < 127))
                found = at + int(good[0]) if len(good) else None
                at += 4096
            if found is None:
                break
            rows.append(row)
            cuts.append(found)
            yield np.array(rows), np.array(cuts)
            rows, cuts, size, low = [], [found], 0, found
        rows.append(row)
        cuts.append(high)
        size += high - low
        if size > limit:
            yield np.array(rows), np.array(cuts)
            rows, cuts, size = [], [high], 0
    if rows:
        yield np.array(rows), np.array(cuts)


class Coder:
    """Encodes and decodes batches; each distinct piece is merged once."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.merger = Merger(ranks)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.words, self.table = Words(400_000), IdTable()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and where each row's ids end."""
        if self.words.full():
            self.forget()
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts, ends = spaced_pieces(data, offsets)
        numbers, new = self.words.number(data, starts, ends)
        if new:
            self.table.extend(*self.merger.encode(new))
        upto = np.concatenate([[0], np.cumsum(self.table.size[numbers])])
        return self.table.ids(numbers), upto[np.searchsorted(starts, offsets[1:])]

    def stream(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """row, ids: a row's ids in one part or several that follow each other."""
        data, offsets = column_bytes(column)
        for rows, cuts in segments(data, offsets):
            ids, upto = self.encode(data, cuts)
            low = 0
            for row, top in zip(rows.tolist(), upto.tolist()):
                yield row, ids[low:top]
                low = top

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; ValueError for an id that is none."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("no such id")
        return self.flat[ragged(self.start[ids], self.size[ids])].tobytes()


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids array<int>: all texts' ids, each match of the vocabulary's pattern merged by itself.

    The pattern is the one of `spaced_pieces`. No string is special. Null or empty texts have no ids.
    Every row gives one row, whatever its doc_id; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            open_row, parts = 0, []

            def row(k: int, parts: list) -> pa.RecordBatch:
                ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                return pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

            for k, ids in code.stream(batch.column(1)):
                if k != open_row:
                    yield row(open_row, parts)
                    open_row, parts = k, []
                parts.append(ids)
            if len(batch):
                yield row(open_row, parts)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, content binary: the bytes that the ids stand for; null ids give none. UTF-8 where whole texts were encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path)
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column(1).slice(i, 1)
                content = code.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([content], pa.binary())], ["doc_id", "content"])

    return coded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def encode_digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """`encode` and `decode` with digests of ids and bytes: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Digests take a text's parts as they come, so that no list of ids leaves the task or is held whole.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path)
        for batch in batches:
            counts, digests = [0] * len(batch), [[hashlib.sha256() for _ in range(len(batch))] for _ in range(2)]
            for row, ids in code.stream(batch.column(1)):
                counts[row] += len(ids)
                digests[0][row].update(ids.astype("<u4").tobytes())
                digests[1][row].update(code.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *(pa.array([d.hexdigest() for d in one], pa.string()) for one in digests)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
