"""Stated items that are contained in texts as they are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items of a block, and letters of its texts; a block is broadcast.
BLOCK_ITEMS, BLOCK_LETTERS = 20_000, 1 << 22
#: Letters of an item that the automaton knows; the rest is compared where they occur.
OPENING = 32


def _found(spark: SparkSession, docs: DataFrame, block: list[tuple]) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)  # BLOCK_ITEMS and BLOCK_LETTERS bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        items = sent.value
        openings: dict[str, list[int]] = {}
        for i, (_, motif) in enumerate(items):
            openings.setdefault(motif[:OPENING], []).append(i)
        everywhere = openings.pop("", [])
        automaton = ahocorasick.Automaton()
        for opening, own in openings.items():
            automaton.add_word(opening, (len(opening), own))
        if openings:
            automaton.make_automaton()
        for batch in batches:
            keys, hits = [], []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if text is None:
                        continue
                    held = {*everywhere}
                    for end, (n, own) in automaton.iter(text) if openings else ():
                        held.update(i for i in own if i not in held and text.startswith(items[i][1], end - n + 1))
                    keys += [key] * len(held)
                    hits += [items[i][0] for i in sorted(held)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long")


def contained_items(docs: DataFrame, items: DataFrame, block: int = BLOCK_ITEMS, letters: int = BLOCK_LETTERS) -> DataFrame:
    """(doc_id, item_id) of every item whose whole text a document has.

    Null texts match nothing, an empty item all other documents; rows with the same id are
    rows of their own.  Items are read in blocks, and one automaton a block goes through
    every document once, so the work doesn't grow with the product of both.
    """
    spark, out, rows, size = docs.sparkSession, [], [], 0
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("motif")).where("motif IS NOT NULL")
    for r in own.toLocalIterator():
        if rows and (len(rows) == block or size + len(r["motif"]) > letters):
            out.append(_found(spark, docs, rows))
            rows, size = [], 0
        rows.append(tuple(r))
        size += len(r["motif"])
    if rows or not out:
        out.append(_found(spark, docs, rows))
    return reduce(DataFrame.unionByName, out)
