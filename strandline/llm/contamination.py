"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Test items are dealt into partitions by the number of their shingles, each twice as wide
as the one before.  For a partition whose largest item has u shingles, a document is cut
into windows of 2u shingles that overlap by half, so that any run of u shingles lies within
one window: sets of like size are compared however long the document is, and the Jaccard
similarity of an item that is contained in a run is high.  An item and a window are a candidate if
they agree in one of ``slots`` MinHash values; a shingle that no item has can't be such a
value, so windows without any item's shingle are passed over.  The whole document is a
further window, for items whose shingles are scattered.  Candidates are verified on the
document's whole shingle set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import strings
from strandline.llm.shingles import hashes, mix

#: Items are searched for in blocks of so many, so that what a task is sent is bounded.
BLOCK_ITEMS = 20_000
SLOTS = 128
#: Hash values that a task makes at a time; a document of more shingles is sketched slot by slot.
PART = 1 << 18


@dataclass
class Index:
    """Sketches of a block of items; sent to the tasks."""

    ids: np.ndarray
    sets: list[np.ndarray]
    shingles: np.ndarray  # of all items, sorted
    salts: np.ndarray
    partitions: list[tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]]  # largest size, items, per slot: sorted values and their items
    every: list[tuple[int, np.ndarray]]  # of each partition: smallest size, the values of all slots, sorted


def build(ids: list[int | None], texts: list[str | None], k: int, slots: int, seed: int = 11) -> Index:
    sets = [np.unique(hashes(t, k)) for t in texts]
    keep = [i for i, s in enumerate(sets) if len(s)]
    ids, sets = [ids[i] for i in keep], [sets[i] for i in keep]
    salts = np.random.default_rng(seed).integers(1, 1 << 63, slots, dtype=np.uint64)
    parts, every = [], []
    level = np.array([len(s).bit_length() for s in sets])
    for p in np.unique(level):
        items = np.flatnonzero(level == p)
        sketch = np.array([[mix(sets[i] ^ salt).min() for salt in salts] for i in items], np.uint64)
        order = np.argsort(sketch, axis=0, kind="stable")
        parts.append((max(len(sets[i]) for i in items), items, [sketch[order[:, j], j] for j in range(slots)], [items[order[:, j]] for j in range(slots)]))
        every.append((min(len(sets[i]) for i in items), np.unique(sketch)))
    return Index(np.array(ids, object), sets, np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64), salts, parts, every)


def matches(run: np.ndarray, index: Index, percent: int) -> list[tuple[int, int, int]]:
    """(item, shingles shared, shingles of the item) of items contained in a document with these shingles, in order."""
    if not len(run) or not len(index.shingles):
        return []
    at = np.minimum(np.searchsorted(index.shingles, run), len(index.shingles) - 1)
    known = np.flatnonzero(index.shingles[at] == run)
    if not len(known):
        return []
    own = np.unique(run[known])
    # windows of each partition, the whole document first; none if even its smallest item has too many shingles that the document lacks
    asked: list[list[tuple[int, int]]] = []
    for (largest, *_), (smallest, _) in zip(index.partitions, index.every, strict=True):
        windows: list[tuple[int, int]] = []
        if 100 * len(own) >= percent * smallest:
            at = np.unique(np.concatenate([known // largest, np.maximum(known // largest - 1, 0)])) * largest
            windows = list(dict.fromkeys([(0, len(run)), *((lo, min(lo + 2 * largest, len(run))) for lo in at.tolist())]))
        asked.append(windows)
    candidates: set[int] = set()
    step = max(1, PART // len(run))
    for first in range(0, len(index.salts) if any(asked) else 0, step):
        mixed = mix(run ^ index.salts[first : first + step, None])
        whole = mixed.min(axis=1)
        for (_, _, values, items), (_, every), windows in zip(index.partitions, index.every, asked, strict=True):
            if not windows:
                continue
            least = np.stack([whole, *(mixed[:, lo:hi].min(axis=1) for lo, hi in windows[1:])])
            # few least values are an item's in any slot; those are looked up in their own
            held = every[np.minimum(np.searchsorted(every, least), len(every) - 1)] == least
            for w, j in zip(*(x.tolist() for x in np.nonzero(held)), strict=True):
                a, b = np.searchsorted(values[first + j], least[w, j]), np.searchsorted(values[first + j], least[w, j], side="right")
                candidates.update(items[first + j][a:b].tolist())
    if not candidates:
        return []
    out = []
    for i in sorted(candidates):
        n, shared = len(index.sets[i]), len(np.intersect1d(index.sets[i], own, assume_unique=True))
        if 100 * shared >= percent * n:
            out.append((i, shared, n))
    return out


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    percent: int = 75,
    k: int = 5,
    slots: int = SLOTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): items of whose shingles a document has ``percent`` or more.

    An item of fewer than k words is one shingle, which only a document of the same words
    has; items and documents without words match nothing, null texts neither.  Repeated
    rows and rows with null ids match on their own.  Items are a stated query set: they are
    read in blocks of ``BLOCK_ITEMS`` and each block is searched for in all documents.  An
    item is contained at exactly ``percent`` too.  A text of any length is searched whole;
    a task holds it and eight bytes a word.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, ids, texts = [], [], []

    def search(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)  # BLOCK_ITEMS items at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = [(key, index.ids[i], shared, n) for key, text in zip(*map(strings, batch.columns), strict=True) for i, shared, n in matches(hashes(text, k), index, percent)]
                columns = zip(*found, strict=True) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shared", "n_shingles"])

        return rows.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_shingles long")

    for r in items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        if len(ids) == BLOCK_ITEMS:
            out.append(search(build(ids, texts, k, slots)))
            ids, texts = [], []
    if ids or not out:
        out.append(search(build(ids, texts, k, slots)))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
