"""Bitmaps of bounded size over hashes: a bit that is set by accident costs work, not results."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest bitmap: 128 MB.
MOST_BITS = 30


def bitmap(hashes: DataFrame, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """(bitmap, bits) by the last bits of the column ``h``; the size follows the number of rows up to a bound.

    Slices are made by the executors; what reaches the driver is the bitmap.
    """
    n = hashes.count()
    bits = min(max((16 * max(n, 1)).bit_length(), 16), most_bits)
    cut = max(bits - 19, 0)  # slices of 64 kB
    slot = F.col("h").bitwiseAND((1 << bits) - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, slots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bit = np.zeros(1 << (bits - cut), np.uint8)
                bit[slots.values.to_numpy()] = 1
                packed = zlib.compress(np.packbits(bit, bitorder="little").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([packed], pa.binary())], names=["part", "bits"])

    low = slot.bitwiseAND((1 << (bits - cut)) - 1)
    slices = hashes.groupBy(F.shiftright(slot, bits - cut).alias("part")).agg(F.collect_set(low).alias("slots"))
    out = np.zeros(max(1 << bits >> 3, 1), np.uint8)
    width = 1 << (bits - cut) >> 3
    if n:
        for r in slices.mapInArrow(fill, "part long, bits binary").toLocalIterator():
            out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return out, bits


def is_set(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
