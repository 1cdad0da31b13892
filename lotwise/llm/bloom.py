"""Bloom filters of fixed size: what is broadcast does not grow with the keys; a full filter only lets more through."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of a filter for each key, and most bits of one (16 MB): of other keys some 2 in 100 pass, 6 at 18 million keys.
BITS_A_KEY, MOST_BITS = 16, 1 << 27


def bit_places(h: np.ndarray, size: int) -> np.ndarray:
    """The two bits of each 64-bit hash in a filter of ``size`` bits (a power of two up to 2^32)."""
    return np.stack([h, h >> np.uint64(32)]) & np.uint64(size - 1)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter (as bytes) lets through."""
    p = bit_places(h, 8 * len(bits))
    return ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def slot_rows(h: np.ndarray, size: int) -> pa.RecordBatch | None:
    """The hashes' bits as rows (slot, bits), one for each 64-bit slot touched."""
    p = np.unique(bit_places(h, size))
    slot = p >> np.uint64(6)
    first = np.flatnonzero(np.diff(slot, prepend=np.uint64(size)))
    if not len(first):
        return None
    value = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first)
    return pa.RecordBatch.from_arrays(
        [pa.array(slot[first].astype(np.int64)), pa.array(value.view(np.int64))], names=["slot", "bits"])


SLOTS = "slot long, bits long"


def gathered(rows: DataFrame, size: int) -> np.ndarray:
    """The filter of all rows (slot, bits): at most ``size`` / 64 rows reach the driver."""
    found = rows.groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint8)


def packed(bits: np.ndarray) -> tuple[int, bytes]:
    return len(bits), pa.compress(bits.tobytes(), "zstd", asbytes=True)


def unpacked(pack: tuple[int, bytes]) -> np.ndarray:
    return np.frombuffer(pa.decompress(pack[1], pack[0], "zstd", asbytes=True), dtype=np.uint8)


def filter_of(keys: DataFrame) -> tuple[int, bytes]:
    """The packed filter of ``keys``, one column of 64-bit hashes without nulls (it is read twice)."""
    keys = keys.toDF("key")
    most, size = min(BITS_A_KEY * keys.count(), MOST_BITS), 1 << 16
    while size < most:
        size *= 2

    def run(batches):
        for batch in batches:
            made = slot_rows(batch.column(0).to_numpy().view(np.uint64), size)
            if made is not None:
                yield made

    return packed(gathered(keys.mapInArrow(run, SLOTS), size))


def among(keys: DataFrame):
    """A function of a column of hashes: true where the hash is one of ``keys``, and for few others.

    Rows it leaves out need not be shuffled to be joined with the keys; the join still decides.
    """
    pack = filter_of(keys)

    @F.pandas_udf("boolean")
    def maybe(some: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = unpacked(pack)
        for h in some:
            yield pd.Series(passes(bits, h.to_numpy().view(np.uint64)))

    return maybe
