"""Vectors of sequences by a model, in batches that waste little on padding.

Rows are dealt by length, so that a batch's sequences are about equally long, and a batch
has as many as a budget of padded letters allows.  A worker makes a model once and keeps it.
Models are registered by name, like ``kmer`` here; a model is anything with ``dims`` and
``embed(list of strings)``, which gives a row of 32-bit floats for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    dims: int

    def embed(self, seqs: list[str]) -> np.ndarray: ...


class Shares:
    """The share of each of the 4**k words in a sequence, in alphabetical order; words with other letters count to none."""

    def __init__(self, k: int = 3) -> None:
        self.k, self.dims = k, 4**k
        self.number = np.full(256, -1, np.int64)
        self.number[list(b"ACGT")] = range(4)

    def embed(self, seqs: list[str]) -> np.ndarray:
        out = np.zeros((len(seqs), self.dims), np.float32)
        for row, s in zip(out, seqs, strict=True):
            letters = self.number[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
            n = max(len(letters) - self.k + 1, 0)
            code, plain = np.zeros(n, np.int64), np.ones(n, bool)
            for i in range(self.k if n else 0):
                code, plain = code * 4 + letters[i : i + n], plain & (letters[i : i + n] >= 0)
            row[:] = np.bincount(code[plain], minlength=self.dims) / max(int(plain.sum()), 1)
        return out


#: What makes a model, by name.
MODELS: dict[str, Callable[[], Model]] = {"kmer": Shares}
_HELD: dict[str, Model] = {}


def register(name: str, make: Callable[[], Model]) -> None:
    MODELS[name] = make


def held(name: str, make: Callable[[], Model]) -> Model:
    """This worker's model of that name, made at the first call."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def batches(lengths: list[int], budget: int, most: int) -> list[tuple[int, int]]:
    """(from, to) of batches of rows in order: as many as fit, padded to the longest, and one at least."""
    out, lo, longest = [], 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, n)
        if i > lo and (i - lo >= most or (i - lo + 1) * longest > budget):
            out.append((lo, i))
            lo, longest = i, n
    if lengths:
        out.append((lo, len(lengths)))
    return out


def embed(df: DataFrame, model: str = "kmer", row_col: str = "row_idx", seq: str = "seq", budget: int = 65_536, most: int = 64) -> DataFrame:
    """(row_idx, embedding, n, padded): each row's vector, its length, and the length that its batch was padded to.

    Rows come back in no order, told apart by their numbers.  A null sequence is an empty
    one.  A model that gives another shape or a number that isn't finite is an error, which
    names a row.  A sequence longer than the budget is a batch of its own.
    """
    make = MODELS[model]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(model, make)
        for part in parts:
            rows, seqs = part.column(0), part.column(1).to_pylist()
            for lo, hi in batches([len(s) for s in seqs], budget, most):
                out = np.asarray(own.embed(seqs[lo:hi]), np.float32)
                if out.shape != (hi - lo, own.dims):
                    raise ValueError(f"{model} gave {out.shape} for {hi - lo} sequences of {own.dims} numbers")
                if not (good := np.isfinite(out).all(1)).all():
                    raise ValueError(f"{model} gave a number that isn't finite for row {rows[lo + int(good.argmin())].as_py()}")
                n = np.array([len(s) for s in seqs[lo:hi]], np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, own.dims, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), vectors, pa.array(n), pa.array(np.full(hi - lo, n.max(), np.int32))], names=["row_idx", "embedding", "n", "padded"])

    own = df.select(F.col(row_col).cast("long").alias("row_idx"), F.coalesce(F.col(seq).cast("string"), F.lit("")).alias("seq"))
    dealt = own.repartitionByRange(F.length("seq"), "row_idx").sortWithinPartitions(F.length("seq"), "row_idx")
    return dealt.mapInArrow(run, "row_idx long, embedding array<float>, n int, padded int")


def padding(embedded: DataFrame) -> DataFrame:
    """(rows, letters, padded, share): how much of what the model saw was padding."""
    out = embedded.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("letters"), F.coalesce(F.sum("padded"), F.lit(0)).alias("padded"))
    return out.withColumn("share", F.when(F.col("padded") > 0, 1 - F.col("letters") / F.col("padded")).otherwise(0.0))
