"""Packed messages between chunks of documents and shards of words (shared by the n-gram and byte-pair operators).

A chunk asks each shard once, in one binary value, whatever the number of words it asks for; the shard answers in
kind. Arrays are packed as byte planes and compressed, so that small numbers in large types cost little.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from lotwise.llm.word_cuts import word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers in one compressed value: least byte widths, byte planes, zstd."""
    head, planes = [len(arrays)], []
    for a in arrays:
        most = int(a.max()) if len(a) else 0
        width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
        head += [len(a), width]
        planes.append(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return np.array(head, dtype=np.int64).tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
    head = np.frombuffer(blob, dtype=np.int64, count=1 + 2 * k)[1:].reshape(k, 2)
    raw = pa.decompress(blob[8 * (1 + 2 * k) :], int((head[:, 0] * head[:, 1]).sum()), "zstd", asbytes=True)
    out, at = [], 0
    for n, width in head.tolist():
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += n * width
    return out


def tidy(out):
    """``out``, when the memory freed so far has gone back to the system: the next group starts small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)
    return out


def word_parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of binary words."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return np.diff(offsets), np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]


def words_of(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data.astype(np.uint8))])


def segments(sorted_keys: np.ndarray):
    """(key, start, end) of the runs of a sorted array."""
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return zip(sorted_keys[starts].tolist(), starts.tolist(), np.append(starts[1:], len(sorted_keys)).tolist())


def word_order(words: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The words by shard: positions, and the shard of each position."""
    shard = (word_hashes(words) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]
