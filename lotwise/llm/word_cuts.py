"""Cut many texts into numbered words at once, on byte arrays (shared by the n-gram operators)."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(chars: bytes) -> np.ndarray:
    """A 256-entry table that is true at the given bytes."""
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


@dataclass
class Cut:
    """``words`` are the different words; token i is ``words[ids[i]]`` of text ``doc[i]`` in piece ``piece[i]``."""

    words: pa.Array
    ids: np.ndarray
    doc: np.ndarray
    piece: np.ndarray


def cut(texts: list[bytes], gap: np.ndarray, fence: np.ndarray) -> Cut:
    """Lower-case A-Z and cut the texts at bytes of ``gap`` and ``fence``; a fence byte also ends a piece.

    The newline must be in one of the two sets: it stands between texts. Pieces never span two texts.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    word = ~(gap | fence)[data]
    edge = np.flatnonzero(np.diff(word, prepend=False).astype(bool))  # ends with a newline, so edges pair up
    start, end = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    tokens = pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
    text_end = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(text_end, start, side="right")
    piece = np.searchsorted(np.flatnonzero(fence[data]), start) + doc
    return Cut(tokens.dictionary.cast(pa.binary()), tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, piece)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _FACTOR
    return x ^ (x >> np.uint64(29))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary words (the same in every task)."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    length = np.diff(offsets)
    place = (np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], length)).astype(np.uint64)
    sums = np.add.reduceat(mixed(data + place * np.uint64(256) + np.uint64(1)), offsets[:-1] - offsets[0])
    return mixed(sums + length.astype(np.uint64))
