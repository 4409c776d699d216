"""Byte-pair encoding and decoding by a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._pieces import IdTable, Words, cut_specials, lowered, one_piece, plain_pieces
from tidemark.llm._text import chunks, column_bytes

_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


class PairIndex:
    """Applies the merges of a vocabulary to many words at once.

    Each pair of neighbours that can merge is in a list of its positions under its rank. Ranks are
    applied in ascending order; a merge at all positions of a rank adds the new pairs left and right
    to the lists of their ranks. Positions that have changed meanwhile are passed over.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.plain = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.left, self.right, self.made = left, right, made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum(sizes)
        symbol = self.plain[raw]
        symbol[ends[sizes > 0] - 1] = self.last[raw[ends[sizes > 0] - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        lives = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for rank, where in zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(at, cut)):
                if rank not in lists:
                    lists[rank] = []
                    heapq.heappush(heap, rank)
                lists[rank].append(where)

        at = np.flatnonzero(after >= 0)
        ranks = self.ranks(symbol[at], symbol[after[at]])
        if (can := ranks != _NONE).any():
            add(at[can], ranks[can])
        while heap:
            rank = heapq.heappop(heap)
            found = lists.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b = self.left[rank], self.right[rank]
            at = at[lives[at] & (symbol[at] == a)]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:
                at = np.sort(at)
                chosen, taken = [], -1
                for i in at.tolist():
                    if i != taken:
                        chosen.append(i)
                        taken = after[i]
                at = np.array(chosen, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[rank]
            lives[gone] = False
            after[at] = beyond = after[gone]
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            changed = np.concatenate([at[beyond >= 0], before[at][before[at] >= 0]])
            if len(changed):
                ranks = self.ranks(symbol[changed], symbol[after[changed]])
                if (can := ranks != _NONE).any():
                    add(changed[can], ranks[can])
        counts = np.add.reduceat(lives, (ends - sizes)[sizes > 0]) if n else np.zeros(0, np.int64)
        out = np.zeros(len(words), np.int64)
        out[sizes > 0] = counts
        return symbol[lives], out


class Coder:
    """Encodes and decodes batches; each distinct piece is merged once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.index = PairIndex(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.token = [""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, code in model["vocab"].items():
            self.token[code] = text
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for text, code in self.specials.items():
            self.token[code] = text.decode()
        self.split = re.compile("(" + "|".join(re.escape(t.decode()) for t in self.specials) + ")")
        self.forget()

    def forget(self) -> None:
        self.words, self.table, self.numerals, self.shown = Words(400_000), IdTable(), [], []

    def normal(self, text: str) -> str:
        """Lower case and NFC outside of special strings."""
        if "<|" not in text:
            return lowered(text)
        return "".join(x if x.encode() in self.specials else lowered(x) for x in self.split.split(text))

    def learn(self, new: list[bytes]) -> None:
        plain = [w for w in new if w not in self.specials]
        ids, counts = self.index.encode(plain)
        parts = iter(np.split(ids, np.cumsum(counts)[:-1])) if plain else iter(())
        lists = [[self.specials[w]] if w in self.specials else next(parts).tolist() for w in new]
        self.table.add(lists)
        self.numerals += [" ".join(map(str, x)) for x in lists]
        self.shown += [" ".join([self.token[i] for i in x]) for x in lists]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        numbers, upto = self.numbers(texts)
        sizes = self.table.size[numbers]
        ids, ends = self.table.ids(numbers), np.concatenate([[0], np.cumsum(sizes)])[upto]
        return np.split(ids, ends[:-1]) if len(texts) else []

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pieces, and where each text's end."""
        if self.words.full():
            self.forget()
        data, offsets = column_bytes(pa.array([self.normal(t) for t in texts], pa.large_string()))
        segments, at, _ = cut_specials(data, offsets, self.specials)
        starts, ends = one_piece(*plain_pieces(data, segments), segments, at)
        numbers, new = self.words.number(data, starts, ends)
        if new:
            self.learn(new)
        return numbers, np.searchsorted(starts, offsets[1:])

    def decode(self, ids) -> str:
        """The tokens joined by spaces, as a vocabulary file without a decoder asks for."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: all texts' ids and what they decode to.

    Null or empty texts have no ids and decode to the empty string. Every row gives one row, whatever
    its doc_id; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocab_path)
        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                ids = [x.tolist() for x in code.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([code.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, vocab_path: str) -> DataFrame:
    """`encode` with digests for ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The pieces' numerals and tokens are joined as they are, so that no list of ids leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocab_path)
        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                numbers, upto = code.numbers([t or "" for t in part.column(1).to_pylist()])
                sizes = np.concatenate([[0], np.cumsum(code.table.size[numbers])])
                every, low, digests = numbers.tolist(), 0, ([], [])
                for top in upto.tolist():
                    for k, texts in enumerate((code.numerals, code.shown)):
                        digests[k].append(hashlib.sha256(" ".join([texts[w] for w in every[low:top]]).encode()).hexdigest())
                    low = top
                counts = np.diff(sizes[np.concatenate([[0], upto])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests[0]), pa.array(digests[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
