"""Hierarchical multi-length packing of token ids."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm._pieces import IdTable, Words, cut_specials, one_piece, spaced_pieces
from tidemark.llm._text import chunks, column_bytes

#: Context sizes, shortest first.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Windows of a step hold so many ids together.
STEP_IDS = 8 * 2048

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"


class Encoder:
    """Ids of a byte-level vocabulary for batches of texts; each distinct piece is encoded once."""

    def __init__(self, ranks_path: str, pattern: str, specials: dict[bytes, int]):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.specials = specials
        self.forget()

    def forget(self) -> None:
        self.words, self.table = Words(), IdTable()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and where each row's ids end."""
        if self.words.full():
            self.forget()
        base = offsets[0]
        data, offsets = data[base : offsets[-1]], offsets - base
        segments, at, codes = cut_specials(data, offsets, self.specials)
        starts, ends = one_piece(*spaced_pieces(data, segments), segments, at)
        numbers, new = self.words.number(data, starts, ends)
        special = set(self.specials)
        self.table.add([[self.specials[w]] if w in special else self.coder.encode_ordinary(w.decode()) for w in new])
        ids = self.table.ids(numbers)
        upto = np.concatenate([[0], np.cumsum(self.table.size[numbers])])
        return ids, upto[np.searchsorted(starts, offsets[1:])]


@lru_cache(2)
def _encoder(ranks_path: str, pattern: str, special: str, special_id: int) -> Encoder:
    return Encoder(ranks_path, pattern, {special.encode(): special_id})


class Packer:
    """Packs the pieces of a partition; holds less than two windows of each tier at a time."""

    def __init__(self, number: int, tiers: tuple[int, ...] = TIERS, step_ids: int = STEP_IDS):
        self.tiers, self.step_ids, self.base = tiers, step_ids, number << 33
        self.pools = {t: deque() for t in tiers}
        self.held = dict.fromkeys(tiers, 0)
        self.windows = self.steps = 0
        self.open: list[list[int]] = []
        self.rows: list[tuple] = []

    def route(self, piece: tuple) -> None:
        """To the shortest context that holds the piece whole."""
        size = len(piece[2])
        if size:
            tier = next(t for t in self.tiers if size <= t)
            self.pools[tier].append(piece)
            self.held[tier] += size

    def step(self, size: int) -> int:
        """The first open step with room for a window."""
        for i, s in enumerate(self.open):
            if s[1] >= size:
                s[1] -= size
                if not s[1]:
                    self.open.pop(i)
                return s[0]
        self.steps += 1
        if size < self.step_ids:
            self.open.append([self.base + self.steps - 1, self.step_ids - size])
        return self.base + self.steps - 1

    def emit(self, pieces: list[tuple], size: int) -> None:
        at, step, seq = 0, self.step(size), self.base + self.windows
        self.windows += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, seq, at, size, step))
            at += len(ids)

    def take(self, tier: int) -> tuple:
        piece = self.pools[tier].popleft()
        self.held[tier] -= len(piece[2])
        return piece

    def window(self, tier: int) -> None:
        """Fills one window from its own tier, its gap from shorter tiers, what is left by a cut."""
        pieces, gap = [], tier
        while gap:
            own = self.pools[tier]
            if own and len(own[0][2]) <= gap:
                pieces.append(self.take(tier))
            else:
                short = next((t for t in reversed(self.tiers) if t < tier and self.pools[t] and len(self.pools[t][0][2]) <= gap), None)
                if short is not None:
                    pieces.append(self.take(short))
                else:
                    doc, start, ids, total = self.take(tier)
                    pieces.append((doc, start, ids[:gap], total))
                    self.route((doc, start + gap, ids[gap:], total))
            gap -= len(pieces[-1][2])
        self.emit(pieces, tier)

    def add(self, doc, ids: np.ndarray) -> None:
        longest, total = self.tiers[-1], len(ids)
        whole = total - total % longest
        for start in range(0, whole, longest):
            self.emit([(doc, start, ids[start : start + longest], total)], longest)
        self.route((doc, whole, ids[whole:], total))
        for tier in self.tiers:
            while self.held[tier] >= tier:
                self.window(tier)

    def close(self) -> None:
        """Packs what is left into windows of falling powers of two, so that none has padding."""
        rest = deque(self.take(t) for t in reversed(self.tiers) for _ in range(len(self.pools[t])))
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            pieces, gap = [], size
            while gap:
                doc, start, ids, total = rest.popleft()
                pieces.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    rest.appendleft((doc, start + gap, ids[gap:], total))
                gap -= len(pieces[-1][2])
            self.emit(pieces, size)
            left -= size

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[] for _ in schema]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: str = "<|endoftext|>", special_id: int = 50256) -> DataFrame:
    """Pieces of all documents in windows of TIERS; a row per piece.

    Documents go to the shortest tier that holds them; those longer than the longest fill its windows
    and leave a rest. A window takes pieces of its own tier, then of shorter ones that fit its gap, and
    cuts a piece only for what is left. The last windows of a partition are falling powers of two, so
    nothing is padded. Windows go to steps of STEP_IDS ids. No shuffle: a partition packs its own rows.

    Null or empty texts have END_ID alone; rows with a null or repeated doc_id are packed as any other;
    other columns are ignored; an empty table gives no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, special, special_id)
        packer = Packer(TaskContext.get().partitionId())
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in chunks(offsets):
                tokens, upto = encoder.encode(data, offsets[i : j + 1])
                low = 0
                for doc, top in zip(ids[i:j], upto.tolist()):
                    packer.add(doc, np.append(tokens[low:top], END_ID))
                    low = top
                if len(packer.rows) > 20_000:
                    yield packer.batch(schema)
        packer.close()
        yield packer.batch(schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
