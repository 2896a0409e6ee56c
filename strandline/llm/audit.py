"""What filters do to a corpus in every order: a first-failure table, counted part by part.

Each document is a mask of the filters that it fails.  For the 32 masks and the 120 orders
a table says at which step a document goes.  Tasks look their documents' masks up in it and
count removals by part, order, step and label; the partial arrays of a part are summed, in
two rounds, so that a part with most of the documents is as many rows as there are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import lean, remove, written

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = len(FILTERS)
#: ``FIRST[mask, order]``: the step, from 0, at which a document goes; STEPS if it stays.
FIRST = np.array([[next((i for i, f in enumerate(o) if m >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for m in range(1 << STEPS)], np.int64)
#: Labels: bit 0 good, bit 1 toxic.
LABELS = 4
CELLS = len(ORDERS) * (STEPS + 1) * LABELS
#: A part's array: the cells, then the number of documents by mask.
SIZE = CELLS + (1 << STEPS)
#: Documents looked up at a time, and parts that a task holds at a time.
ROWS, PARTS, SALTS = 4096, 256, 64
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)


def failures(text: Column, repeated: Column) -> Column:
    """The mask of the filters that a text fails; a null text is empty.  ``repeated`` is filter E's condition."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = (
        F.size(words) < 50,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65,
        capitals.cast("long") * 100 > F.length(t).cast("long") * 5,
        t.rlike("[#$%&*|]"),
        repeated,
    )
    mask = F.lit(0)
    for i, c in enumerate(conditions):
        mask = mask.bitwiseOR(F.when(c, 1 << i).otherwise(0))
    return mask


def masked(docs: DataFrame, labels: DataFrame, paths: list[str], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, label) of each row, in tables that are added to ``paths``.

    Texts are read once; what moves is a digest.  Copies of a text meet only as partial
    minima, and the join back is one whose large partitions Spark splits.
    """
    t = F.col(text_col).cast("string")
    own = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(t, F.lit("")).cast("binary"), 256).alias("digest"),
        failures(t, F.lit(False)).alias("mask"),
    )
    own = written(own, "masks", paths)
    first = own.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").select("digest", "first")
    good, toxic = (F.max(F.when(F.col(c) == 1, b).otherwise(0)) for c, b in (("quality", 1), ("toxic", 2)))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((good + toxic).alias("label"))
    out = own.join(marks, "id", "left").join(first.hint("merge"), "digest", "left")
    repeated = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    mask = F.col("mask").bitwiseOR(F.when(repeated, 1 << 4).otherwise(0))
    return out.select("part", mask.cast("int").alias("mask"), F.coalesce("label", F.lit(0)).cast("int").alias("label"))


def _packed(held: dict[str, np.ndarray], salt: int) -> pa.RecordBatch:
    zipper = zstandard.ZstdCompressor(level=1)
    rows = [zipper.compress(x.tobytes()) for x in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["part", "salt", "counts"])


def _added(held: dict[str, np.ndarray], part: str, counts: np.ndarray) -> None:
    if part in held:
        held[part] += counts
    else:
        held[part] = counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial arrays of the parts."""
    lean()
    held: dict[str, np.ndarray] = {}
    task, orders = TaskContext.get(), np.arange(len(ORDERS)) * ((STEPS + 1) * LABELS)
    salt = task.partitionId() % SALTS if task else 0
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            b = batch.slice(lo, ROWS)
            parts = b.column(0).dictionary_encode()
            code = parts.indices.to_numpy(zero_copy_only=False)
            mask, label = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            for i, part in enumerate(parts.dictionary.to_pylist()):
                mine = code == i
                cells = FIRST[mask[mine]] * LABELS + orders + label[mine][:, None]
                _added(held, part, np.concatenate([np.bincount(cells.ravel(), minlength=CELLS), np.bincount(mask[mine], minlength=1 << STEPS)]))
            if len(held) >= PARTS:
                yield _packed(held, salt)
                held = {}
    if held:
        yield _packed(held, salt)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array for each run of rows of a part; they come sorted by part."""
    lean()
    unzip, held = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if held and part not in held:
                yield _packed(held, 0)
                held = {}
            _added(held, part, np.frombuffer(unzip.decompress(packed.as_py()), np.int64).copy())
    if held:
        yield _packed(held, 0)


def figures(counts: np.ndarray) -> list[np.ndarray]:
    """``COLUMNS`` for the orders and steps of one part, from its array."""
    cells, masks = counts[:CELLS].reshape(len(ORDERS), STEPS + 1, LABELS), counts[CELLS:]
    letter = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    removed = cells[:, :STEPS].sum(2)
    fails = np.array([masks[np.arange(len(masks)) >> i & 1 > 0].sum() for i in range(STEPS)])
    shapley = np.zeros(STEPS, np.int64)
    np.add.at(shapley, letter.ravel(), removed.ravel())
    return [
        masks.sum() - np.cumsum(removed, axis=1),
        removed,
        fails[letter] - removed,
        masks[1 << letter],
        cells[:, :STEPS, 1] + cells[:, :STEPS, 3],
        cells[:, :STEPS, 2] + cells[:, :STEPS, 3],
        shapley[letter],
    ]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    order = pa.array([o for o in ORDERS for _ in range(STEPS)])
    step = pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32())
    for batch in _sum(batches):
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            found = figures(np.frombuffer(unzip.decompress(packed.as_py()), np.int64))
            columns = [pa.array(x.ravel().astype(np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(order), pa.string()), order, step, *columns], names=["part", "filter_order", "step", *COLUMNS])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the five filters and step, with the counts named in ``COLUMNS``.

    A null text is empty and a null part the empty string.  Of rows with equal texts those
    with a larger id than the least one fail filter E, so rows that share the least id all
    pass it, and so does a row without an id, which is no copy and has none.  Several label
    rows of an id are one, good if any is good and toxic if any is toxic; labels of no
    document count nowhere.  Texts of any length are judged whole.  Other columns are not
    looked at.  No rows give no rows.
    """
    paths: list[str] = []
    found = masked(docs, labels, paths, id_col, text_col, part_col)
    counts = "part string, salt int, counts binary"
    partial = written(found.mapInArrow(_count, counts), "counts", paths)
    remove(docs.sparkSession, paths.pop(0))
    summed = partial.repartition("part", "salt").sortWithinPartitions("part").mapInArrow(_sum, counts)
    return summed.repartition("part").sortWithinPartitions("part").mapInArrow(_report, SCHEMA)
