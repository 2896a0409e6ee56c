"""Line dedup: sorted line hashes are streamed, and documents get keep bitmaps, not text.

1. A scan emits (hash, document, position) of each line that is long enough.
2. The rows are range-partitioned by (hash, document descending), so that a line that a
   third of all documents have spreads over many partitions, and sorted with the position.
3. Each partition is streamed.  A line's first document is the one that keeps it.  What a
   partition can't know, because a line's rows go on beyond it, it leaves as edge rows,
   with one summary row for its first and its last line: two rows a partition, which are
   summed up and joined back.
4. The dropped positions of a document become one compressed bitmap.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.shared import NO_ID, fresh, partitions, strings, written

SPACE = b" \t\n\x0b\x0c\r"
DROP, EDGE, SUMMARY = 0, 1, 2
ROWS = "kind int, h1 long, h2 long, id long, th long, pos int, n long"


def line_keys(text: str | None) -> list[bytes]:
    """A line's key: white space stripped at both ends, A-Z in lower case.  No text is one empty line."""
    return [line.strip(SPACE) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def hash_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, th, pos, n): th is the hash of the text, n its number of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, hashes, positions, counts = [], [], [], [], []
            for key, th, text in zip(*map(strings, batch.columns), strict=True):
                lines = line_keys(text)
                for pos, line in enumerate(lines):
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "surrogatepass")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(line))
                        ids.append(key)
                        hashes.append(th)
                        positions.append(pos)
                        counts.append(len(lines))
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(positions, pa.int32()), pa.array(counts, pa.int64())],
                names=["h1", "h2", "id", "th", "pos", "n"],
            )

    return docs.mapInArrow(run, "h1 long, h2 long, id long, th long, pos int, n long")


def stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """Rows as in ``ROWS`` of one partition, whose rows are sorted by hash, then by document descending.

    No more is held than the rows of a line's first ``min_docs - 1`` documents.
    """
    line, first, docs, last, top, pending = None, True, 0, None, None, []
    for batch in batches:
        for h1, h2, key, th, pos, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (h1, h2) != line:
                if line is not None and first:
                    yield SUMMARY, *line, top, 0, 0, docs
                    first = False
                elif line is None:
                    first = True
                line, docs, last, top, pending = (h1, h2), 0, None, key, []
            if key != last:
                docs, last = docs + 1, key
                if docs == min_docs and not first:
                    yield from pending
                    pending = []
            if first:  # it may have begun in the partition before
                yield EDGE, h1, h2, key, th, pos, n
            elif docs >= min_docs:
                yield DROP, h1, h2, key, th, pos, n
            elif docs > 1:
                pending.append((DROP, h1, h2, key, th, pos, n))
    if line is not None:
        yield SUMMARY, *line, top, 0, 0, docs
        for row in pending:
            yield EDGE, *row[1:]


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, bitmap) of each document that loses lines; bit i of the bitmap says that line i stays.

    ``id`` is the document's id (the least long for a null one), ``th`` the hash of its
    text: repeated rows count as one document and share their bitmap.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    lines = hash_lines(rows, min_chars)
    order = (F.col("h1"), F.col("h2"), F.col("id").desc())
    lines = lines.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order, "th", "pos")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = ["kind", "h1", "h2", "id", "th", "pos", "n"]
        held = []
        for row in stream(batches, min_docs):
            held.append(row)
            if len(held) == 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    found = written(lines.mapInArrow(streamed, ROWS), "lines")
    # two rows a partition at most
    edges = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("id").alias("top")).where(F.col("docs") >= min_docs)
    late = found.where(F.col("kind") == EDGE).join(F.broadcast(edges), ["h1", "h2"]).where(F.col("id") != F.col("top"))
    dropped = found.where(F.col("kind") == DROP).select("id", "th", "pos", "n").unionByName(late.select("id", "th", "pos", "n"))
    return dropped.groupBy("id", "th").agg(F.collect_set("pos").alias("dropped"), F.max("n").alias("n")).select("id", "th", _bitmap("dropped", "n").alias("bitmap"))


@F.arrow_udf(T.BinaryType())
def _bitmap(dropped: pa.Array, n: pa.Array) -> pa.Array:
    out = []
    for positions, lines in zip(dropped, n.to_pylist(), strict=True):
        keep = np.ones(lines, np.uint8)
        keep[positions.values.to_numpy(zero_copy_only=False)] = 0
        out.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
def _kept(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    texts, lines, drops = [], [], []
    for t, b in zip(strings(text), strings(bitmap), strict=True):
        n, kept = (t or "").count("\n") + 1, t
        stays = n
        if b is not None:
            keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), bitorder="little")[:n]
            stays = int(keep.sum())
            kept = "\n".join(line for line, k in zip(t.split("\n"), keep.tolist(), strict=True) if k)
        texts.append(kept)
        lines.append(n)
        drops.append(n - stays)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(drops, pa.int64())], names=["text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their texts less the repeated lines, and columns ``n_lines`` and ``n_dropped``.

    A key that ``min_docs`` documents have stays in the one with the largest id only.  A null
    text is one empty line and stays null; a null id is below all others, and rows without
    one are one document.  Repeated rows are one document, and each of them is changed alike.
    Columns named like the new ones are replaced; all others are kept.  A text of any length
    is split whole; a task holds it and its lines.  No rows give no rows.
    """
    key, th, bitmap, kept = (fresh(docs, c) for c in ("id", "th", "bitmap", "kept"))
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, id_col, text_col).select(F.col("id").alias(key), F.col("th").alias(th), F.col("bitmap").alias(bitmap))
    on = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(th))
    out = docs.join(bitmaps.hint("shuffle_hash"), on, "left").withColumn(kept, _kept(F.col(text_col).cast("string"), bitmap))
    out = out.withColumns({text_col: F.col(f"{kept}.text"), "n_lines": F.col(f"{kept}.n_lines"), "n_dropped": F.col(f"{kept}.n_dropped")})
    return out.drop(key, th, bitmap, kept)
