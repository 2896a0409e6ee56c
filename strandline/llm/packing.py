"""Cost-balanced packing of tokenized documents into sequences of a fixed length.

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention stays within a
document.  Pieces are placed in descending order, each on the sequence of lowest cost
that has room for it.  Only a piece that fits nowhere is cut, over the sequences with
the most room.  A block of tokens gets as few sequences as can hold it, so that at most
one sequence's worth of padding remains for a block.

A task packs what it reads, block by block, without a shuffle: the memory of a task is
that of one block, and no key decides where rows go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.shared import blocks, documents
from strandline.llm.tokens import encoder

#: A task's block: packed once it holds so many tokens or documents.
BLOCK_TOKENS = 1 << 21
BLOCK_DOCS = 1 << 15

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(lengths: np.ndarray, linear: float, quadratic: float) -> np.ndarray:
    n = np.asarray(lengths, np.float64)
    return linear * n + quadratic * n * n


def place(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given numbers of tokens.

    Full pieces of ``capacity`` tokens fill a sequence each; the remainders are placed.
    """
    lengths = np.asarray(lengths, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    whole = lengths // capacity
    sequence = 0
    for d in np.flatnonzero(whole):
        for k in range(int(whole[d])):
            out.append((int(d), k * capacity, capacity, sequence, 0))
            sequence += 1
    rest = lengths - whole * capacity
    count = int(-(-rest.sum() // capacity))
    if not count:
        return out
    room, load = np.full(count, capacity, np.int64), np.zeros(count)
    order = np.argsort(-rest, kind="stable")
    for d in order[: int((rest > 0).sum())]:
        n, start = int(rest[d]), int(whole[d] * capacity)
        while n:
            fits = np.flatnonzero(room >= n)
            s = int(fits[load[fits].argmin()]) if len(fits) else int(room.argmax())
            part = min(n, int(room[s]))
            out.append((int(d), start, part, sequence + s, int(capacity - room[s])))
            load[s] += linear * part + quadratic * part * part
            room[s] -= part
            start, n = start + part, n - part
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    mode: str | None = "byte",
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it comes from, and which sequence holds it at which offset.

    A null text is empty: its only token is ``end_id``.  Rows are packed as they are, so a
    repeated row or a null id is a document of its own.  No rows give no rows.  Columns
    other than the id and the text are not looked at.  Documents of equal length are
    placed in the order in which a task reads them, and of sequences of equal cost the
    first is taken.  A text of any length is encoded whole; its ids fill sequences of
    their own but for the rest, and a task holds the ids of one block or one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(vocabulary, mode)
        ids, tokens, held = [], [], 0
        sequence = TaskContext.get().partitionId() << 36

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal ids, tokens, held, sequence
            rows = place([len(t) for t in tokens], capacity, linear, quadratic)
            if rows:
                d, start, length, at, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                crc = np.fromiter((zlib.crc32(tokens[i][s : s + n].tobytes()) for i, s, n in zip(d, start, length, strict=True)), np.int64, len(rows))
                total = np.fromiter(map(len, tokens), np.int64, len(tokens))[d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(pa.array(d)), *map(pa.array, (start, length, crc, total, sequence + at, offset, cost(length, linear, quadratic)))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"],
                )
                sequence += int(at.max()) + 1
            ids, tokens, held = [], [], 0

        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1)):
                keys = batch.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for key, coded in zip(keys, coder.encode(texts), strict=True):
                    ids.append(key)
                    tokens.append(np.append(coded, np.uint32(end_id)).astype("<u4", copy=False))
                    held += len(tokens[-1])
                    if held >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                        yield from packed()
        yield from packed()

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)
