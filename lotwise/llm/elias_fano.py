"""Elias-Fano sequences and the n-gram trie made of them, on numpy arrays that may be memory-mapped.

A non-decreasing sequence is stored as low bits, packed, and high bits, in unary: two bits a value and the
logarithm of the mean gap. ``access`` reads values by position, ``find`` positions by value; both work on
whole arrays of queries.

The trie has three levels. The successors of a context are one range of the next level, whose start is a
monotone pointer. Their ids are stored relative to the context: each range goes on from the last
value of the range before it, so that a level is one increasing sequence, and looking a word up after its
context is a search for (value before the range + 1 + id) that must end inside the range. Nodes carry 16-bit
codes of probabilities.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
#: A code c > 0 stands for the probability 10 ** -(c - 1) / SCALE; 0 for none.
SCALE = 4096


def encode_probability(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log10(p) * SCALE) + 1
    return np.where(p > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


def decode_probability(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1.0 - code.astype(np.float64)) / SCALE), 0.0)


_ONES, _HIGHS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the r-th set bit of a byte, at 8 * byte + r.
_IN_BYTE = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[r] for byte in range(256) for r in range(8)], dtype=np.uint64)


def select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each 64-bit word: its byte by running bit counts, then a table."""
    r = r.astype(np.uint64)
    s = x - ((x >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    full = ((((r * _ONES) | _HIGHS) - s) >> _U(7)) & _ONES  # bytes that end before the bit
    place = ((full * _ONES) >> _U(56)) << _U(3)
    before = ((s << _U(8)) >> place) & _U(255)
    return (place + _IN_BYTE[((x >> place) & _U(255)) * _U(8) + r - before]).astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits side by side in 64-bit words (and one word to spare)."""
    words = np.zeros(len(values) * width // 64 + 2, dtype=np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, off = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(values << off, first)
        over = np.flatnonzero((at & 63) + width > 64)
        words[word[over] + 1] |= values[over] >> (_U(64) - off[over])
    return words


def read_bits(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), dtype=np.uint64)
    at = i.astype(np.int64) * width
    word, off = at >> 6, (at & 63).astype(np.uint64)
    high = np.where(off > 0, words[word + 1] << (_U(64) - np.maximum(off, _U(1))), _U(0))
    return (words[word] >> off | high) & _U((1 << width) - 1)


class EliasFano:
    """Read access to a sequence made by ``encode``; ``arrays`` are what is stored."""

    def __init__(self, head, low, high):
        self.arrays = (head, low, high)
        self.n, self.width, self.top = (int(x) for x in head)
        self.low, self.high = low, high
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        high = values >> _U(width)
        top = most >> width
        unary = np.zeros(-(-(n + top + 1) // 64) * 64, dtype=np.uint8)
        unary[high.astype(np.int64) + np.arange(n)] = 1
        low = pack_bits(values & _U((1 << width) - 1), width)
        return cls(np.array([n, width, top], dtype=np.int64), low, np.packbits(unary, bitorder="little").view(np.uint64))

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        i = np.asarray(i, dtype=np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + select_in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.width) | read_bits(self.low, i, self.width).astype(np.int64)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits under ``h``."""
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        place = word * 64 + select_in_word(~self.high[word], k - self.zeros[word])
        return np.where(h > 0, place - k, 0)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Positions of values ``x`` in an increasing sequence, -1 where absent."""
        x = np.asarray(x, dtype=np.int64)
        h = x >> self.width
        fits = (x >= 0) & (h <= self.top)
        h = np.where(fits, h, 0)
        a, b = self._before(h), self._before(h + 1)
        end = np.where(fits, b, a)
        b = end.copy()
        target = (x & ((1 << self.width) - 1)).astype(np.uint64)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = read_bits(self.low, mid, self.width) < target[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        if not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        hit = (a < end) & (read_bits(self.low, np.minimum(a, self.n - 1), self.width) == target)
        return np.where(hit, a, -1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted columns begins."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _relative(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of all ranges as one increasing sequence, each range going on from the last value before it."""
    size = np.diff(np.append(starts, len(ids)))
    last = ids[np.append(starts[1:], len(ids)) - 1] + 1 if len(ids) else ids
    return ids + 1 + np.repeat(np.cumsum(last) - last, size)


class Trie:
    """Levels of words u, pairs (u, v) and triples (u, v, w) with codes of probabilities."""

    SEQUENCES = ("words", "to_pairs", "pairs", "to_triples", "triples")
    CODES = ("word_backoff", "pair_prob", "pair_backoff", "triple_prob")

    def __init__(self, **parts):
        self.__dict__.update(parts)

    @classmethod
    def build(cls, u, v, w, count, context_count, mu2: float, mu3: float) -> Trie:
        """From sorted, different triples: ``count`` of each, ``context_count`` of its u in the training texts.

        Probabilities are smoothed as p3(w|u,v) = prob(u,v,w) + backoff(u,v) * p2(w|v) and p2(v|u) = prob(u,v) +
        backoff(u) * p1(v), with backoff mu / (count of the context + mu).
        """
        at2 = _starts(u, v)
        at1 = _starts(u[at2])
        size3 = np.diff(np.append(at2, len(u)))
        count2 = np.add.reduceat(count, at2) if len(u) else count
        total1 = context_count[at2]
        return cls(
            words=EliasFano.encode(u[at2][at1]),
            to_pairs=EliasFano.encode(np.append(at1, len(at2))),
            pairs=EliasFano.encode(_relative(v[at2], at1)),
            to_triples=EliasFano.encode(np.append(at2, len(u))),
            triples=EliasFano.encode(_relative(w, at2)),
            word_backoff=encode_probability(mu2 / (total1[at1] + mu2)),
            pair_prob=encode_probability(count2 / (total1 + mu2)),
            pair_backoff=encode_probability(mu3 / (count2 + mu3)),
            triple_prob=encode_probability(count / (np.repeat(count2, size3) + mu3)),
        )

    @staticmethod
    def _successor(start: EliasFano, level: EliasFano, parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Positions of ``ids`` among the successors of ``parent`` (-1: none)."""
        found = np.full(len(ids), -1, dtype=np.int64)
        live = np.flatnonzero(parent >= 0)
        if len(live):
            # queries come in the order of their parents, so equal parents stand together
            new = np.diff(parent[live], prepend=-1) != 0
            nodes, back = parent[live][new], np.cumsum(new) - 1
            a, b = start.access(nodes), start.access(nodes + 1)
            base = np.where(a > 0, level.access(np.maximum(a - 1, 0)), 0)
            at = level.find(base[back] + 1 + ids[live])
            found[live] = np.where((at >= a[back]) & (at < b[back]), at, -1)
        return found

    def lookup(self, u, v, size3, w):
        """Codes (prob, backoff) of sorted pairs (u, v), and prob of their triples: ``size3`` words of ``w`` to a pair."""
        new = np.diff(u, prepend=-1) != 0
        pair = self._successor(self.to_pairs, self.pairs, self.words.find(u[new])[np.cumsum(new) - 1], v)
        triple = self._successor(self.to_triples, self.triples, np.repeat(pair, size3), w)

        def code(codes, at):
            return np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype(np.uint16) if len(codes) else np.zeros(len(at), np.uint16)

        return code(self.pair_prob, pair), code(self.pair_backoff, pair), code(self.triple_prob, triple)

    def arrays(self) -> list[np.ndarray]:
        return [a for s in self.SEQUENCES for a in getattr(self, s).arrays] + [getattr(self, c) for c in self.CODES]

    def save(self, file) -> None:
        """Write all levels to ``file``: sizes first, every array at a multiple of 8 bytes."""
        arrays = self.arrays()
        file.write(np.array([a.nbytes for a in arrays], dtype=np.int64).tobytes())
        for a in arrays:
            file.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        file.flush()

    @classmethod
    def mapped(cls, raw: np.ndarray) -> Trie:
        """The trie on the bytes of ``save``, mapped or not: nothing is copied."""
        kinds = [np.int64, np.uint64, np.uint64] * len(cls.SEQUENCES) + [np.uint16] * len(cls.CODES)
        sizes = raw[: 8 * len(kinds)].view(np.int64)
        arrays, at = [], 8 * len(kinds)
        for size, kind in zip(sizes.tolist(), kinds):
            arrays.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        parts = {s: EliasFano(*arrays[3 * k : 3 * k + 3]) for k, s in enumerate(cls.SEQUENCES)}
        return cls(**parts, **dict(zip(cls.CODES, arrays[3 * len(cls.SEQUENCES) :])))
