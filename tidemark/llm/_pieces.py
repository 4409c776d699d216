"""Splits texts into the pieces that byte-pair vocabularies work on, a chunk of rows at a time."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from tidemark.llm._text import ragged, span_hashes

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: Unicode White_Space.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(every[m.start()]), ord(every[m.end() - 1])
            out[lo : hi + 1] = kind
    out[_BLANKS] = BLANK
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the byte that each begins at."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.flatnonzero((data & 0xC0) != 0x80)


def _contractions(points, kinds, starts, first) -> None:
    """'s 't 'm 'd 're 've 'll begin at an apostrophe that begins a piece and stands before a letter."""
    n = len(points)
    at = np.flatnonzero((points == 39) & starts)
    at = at[at + 1 < n]
    at = at[(kinds[at + 1] == LETTER) & ~first[at + 1]]
    for i in at.tolist():
        a = chr(points[i + 1])
        two = i + 2 < n and not first[i + 2] and kinds[i + 2] == LETTER
        size = 1 if a in "stmd" else 2 if two and a + chr(points[i + 2]) in ("re", "ve", "ll") else 0
        if size:
            starts[i + 1] = False
            if (end := i + 1 + size) < n and not first[end] and kinds[end] == LETTER:
                starts[end] = True


def spaced_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of a vocabulary that puts a space before words.

    Pieces are runs of letters, numbers or other signs with one space before, contractions, and
    white space; they cover all bytes and end where a row ends.
    """
    points, lead = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offsets)] = True
    first = first[:n]
    first[0] = True
    begins = first.copy()
    begins[1:] |= kinds[1:] != kinds[:-1]
    blank = kinds == BLANK
    led = np.zeros(n, bool)
    led[1:] = (points[:-1] == 32) & ~first[1:]
    starts = begins & ~(led & ~blank)
    starts[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:]
    _contractions(points, kinds, starts, first)
    at = lead[starts]
    return at, np.append(at[1:], len(data))


def plain_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of runs of letters, single numbers, runs of other signs, contractions; no white space."""
    points, lead = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, offsets)] = True
    first = first[:n]
    first[0] = True
    starts = first.copy()
    starts[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
    _contractions(points, kinds, starts, first)
    at = lead[starts]
    ends = np.append(at[1:], len(data))
    keep = kinds[starts] != BLANK
    return at[keep], ends[keep]


def cut_specials(data: np.ndarray, offsets: np.ndarray, specials: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' offsets with further cuts around special strings; the specials' starts and ids."""
    raw = data.tobytes()
    found = []
    for text, code in specials.items():
        at = raw.find(text)
        while at >= 0:
            row = np.searchsorted(offsets, at, "right")
            if at + len(text) <= offsets[row]:
                found.append((at, at + len(text), code))
            at = raw.find(text, at + 1)
    found.sort()
    cuts = np.array([x for s, e, _ in found for x in (s, e)], np.int64)
    return np.union1d(offsets, cuts), np.array([s for s, _, _ in found], np.int64), np.array([c for _, _, c in found], np.int64)


def one_piece(starts, ends, segments, specials) -> tuple[np.ndarray, np.ndarray]:
    """Joins the pieces inside each special string to one."""
    if not len(specials):
        return starts, ends
    seg = np.searchsorted(segments, starts, "right") - 1
    inside = np.isin(segments[seg], specials)
    keep = ~inside | (segments[seg] == starts)
    ends = np.where(inside & keep, segments[np.minimum(seg + 1, len(segments) - 1)], ends)
    return starts[keep], ends[keep]


def lowered(text: str) -> str:
    """NFC, each character in lower case by itself."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Words:
    """Numbers distinct pieces across batches by open addressing; starts anew when it holds `most`, so that memory is bounded.

    Pieces are found by hash and then compared byte by byte; different ones of one hash are told apart.
    """

    def __init__(self, most: int = 1_000_000):
        self.most, self.count, self.total = most, 0, 0
        self.clashes: dict[bytes, int] = {}
        self.flat, self.start, self.size, self.used = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.bits = (2 * most).bit_length()
        self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def full(self) -> bool:
        return self.total > self.most * 3 // 4

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot that holds each hash, or the empty slot where its search ends; whether it is held."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != hashes[open_]) & (found != 0)]
        return slot, self.keys[slot] == hashes

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Adds distinct new hashes; of those that meet in a slot one stays and the others search on."""
        while len(hashes):
            slot, _ = self._slots(hashes)
            self.keys[slot] = hashes
            self.numbers[slot] = numbers
            lost = self.keys[slot] != hashes
            hashes, numbers = hashes[lost], numbers[lost]

    def _keep(self, pieces: list[bytes]) -> None:
        """Stores the bytes of the pieces numbered next."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.total + len(pieces) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(pieces), np.uint8)
        self.start[self.total : self.total + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.total : self.total + len(pieces)] = sizes
        self.used += total
        self.total += len(pieces)

    def _other(self, data, starts, ends, numbers) -> np.ndarray:
        """The pieces whose bytes are not those of their number."""
        sizes = ends - starts
        wrong = self.size[numbers] != sizes
        sizes = np.where(wrong, 0, sizes)
        differ = np.flatnonzero(data[ragged(starts, sizes)] != self.flat[ragged(self.start[numbers], sizes)])
        wrong[np.searchsorted(np.cumsum(sizes), differ, "right")] = True
        return np.flatnonzero(wrong)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Each piece's number, and the pieces seen for the first time in the order of their numbers."""
        hashes = span_hashes(data, starts, ends)
        slot, held = self._slots(hashes)
        out, new = self.numbers[slot].astype(np.int64), []
        missing = np.flatnonzero(~held)
        if len(missing):
            keys, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            numbers = np.arange(self.total, self.total + len(keys))
            if len(keys) + self.count > (1 << self.bits) // 2:
                self._grow()
            self._put(keys, numbers)
            self.count += len(keys)
            out[missing] = numbers[back]
            first = missing[at]
            raw = data.tobytes()
            new = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
            self._keep(new)
        for i in self._other(data, starts, ends, out).tolist():
            piece = data[starts[i] : ends[i]].tobytes()
            if piece not in self.clashes:
                self.clashes[piece] = self.total
                self._keep([piece])
                new.append(piece)
            out[i] = self.clashes[piece]
        return out, new

    def _grow(self) -> None:
        keys, numbers = self.keys, self.numbers
        self.bits += 1
        self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        used = keys != 0
        self._put(keys[used], numbers[used])


class IdTable:
    """The ids of numbered pieces, as one flat array."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def add(self, lists: list) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.extend(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes)

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds the ids of the pieces numbered next, one after another, and how many each has."""
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = ids
        self.start[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + len(sizes)] = sizes
        self.used += total
        self.count += len(sizes)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[numbers], self.size[numbers])]
