"""Toy sequences with planted motifs, for trying out a training run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.operators.sampling import balanced_labels


def words(motifs: tuple[str, ...], k: int = 6) -> set[str]:
    return {m[i : i + k] for m in motifs for i in range(len(m) - k + 1)}


def disjoint(one: tuple[str, ...], other: tuple[str, ...], k: int = 6) -> None:
    """Raises if motifs of two classes share a word: the classes would be harder to tell apart than is said."""
    if both := sorted(words(one, k) & words(other, k)):
        raise ValueError(f"words in motifs of both classes: {both}")


def places(lengths: list[int], width: int, draw: Iterator[int], attempts: int = 100) -> list[int]:
    """Non-overlapping places for motifs of these lengths, one after the other, each tried so many times."""
    taken: list[tuple[int, int]] = []
    for n in lengths:
        for _ in range(attempts):
            at = next(draw) % (width - n + 1) if width >= n else 0
            if width >= n and all(at + n <= a or at >= b for a, b in taken):
                taken.append((at, at + n))
                break
        else:
            raise ValueError(f"no room for a motif of {n} in {width} letters after {attempts} attempts")
    return [a for a, _ in taken]


def numbers(*labels: object) -> Iterator[int]:
    """Endless 32-bit numbers of the labels' sha256."""
    block = 0
    while True:
        yield from np.frombuffer(hashlib.sha256(":".join(map(str, (*labels, block))).encode()).digest(), ">u4").tolist()
        block += 1


def planted(rows: DataFrame, motifs: dict[int, tuple[str, ...]], width: int = 300, gc: float = 0.5, id_col: str = "row", seed: str = "42") -> DataFrame:
    """(row, sequence, label): a letter by chance at each place, and the motifs of the row's label, which do not overlap.

    Labels are balanced over the rows; everything follows a hash of seed and row, so a lost
    task makes the same again.
    """
    disjoint(motifs[0], motifs[1])
    bounds = np.cumsum([(1 - gc) / 2, gc / 2, gc / 2]) * 2.0**32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                draw = numbers(seed, row)
                letters = np.frombuffer(b"ACGT", np.uint8)[np.searchsorted(bounds, [next(draw) for _ in range(width)], side="right")].copy()
                for motif, at in zip(motifs[label], places([*map(len, motifs[label])], width, draw), strict=True):
                    letters[at : at + len(motif)] = np.frombuffer(motif.encode(), np.uint8)
                out.append(letters.tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(1)], names=["row", "sequence", "label"])

    labelled = balanced_labels(rows.select(id_col), id_col, seed).select(rows[id_col].cast("long").alias("row"), "label")
    return labelled.mapInArrow(run, "row long, sequence string, label int")
