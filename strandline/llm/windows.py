"""Removal of repeated passages: Rabin-Karp hashes of every window of a number of words.

1. A scan hashes each window of each text.  Windows that a task has seen before, in the
   order of documents and places, are repeats at once.  All others go, as hashes with their
   documents and places, to the bucket that a second hash names; a task sends a window once,
   so that no window is heavy.
2. A bucket's hashes are counted.  Of equal windows the first in order stays and the others
   are repeats; they go to the group of their documents.
3. There repeats of a document become maximal intervals, which meet the texts again.

Windows are equal if 64 bits of one polynomial and, of another, 16 bits and the bucket's
number are: 80 bits, and as many more as there are doublings of the buckets, which grow with
the input.  A false match among n windows so has a chance of n * n / 2**81 over the number
of buckets: 1e-8 for 1e8 windows in 128 buckets, 1e-4 for 1e13 in 200,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import shingles
from strandline.llm.shared import NO_ID, fresh, lean, partitions, remove, strings, written
from strandline.llm.shingles import mix

#: Windows that a task sends together, windows hashed at a time, words that one row holds back.
FLUSH, PART, TOLD = 1 << 20, 1 << 17, 1 << 16
OTHER = np.uint64(0xA0761D6478BD642F)
SENT = "bucket int, home int, owners binary, counts binary, starts binary, h binary, g binary"
FOUND = "bucket int, home int, owners binary, counts binary, starts binary"


def window_hashes(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, other hashes) of the windows of ``width`` words from each word on, and the number of words."""
    words = shingles.word_hashes(text, cased=True)
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), len(words)
    out = np.empty((2, n), np.uint64)
    power, inverse = shingles._powers(min(n, PART) + width)
    for lo in range(0, n, PART):
        part = words[lo : lo + PART + width - 1]
        for row, values in zip(out, (part, mix(part ^ OTHER)), strict=True):
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values * power[: len(part)], out=prefix[1:])
            row[lo : lo + PART] = mix((prefix[width:] - prefix[:-width]) * inverse[: len(prefix) - width])
    return out[0], out[1], len(words)


def equal_runs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): equal (h, g) stand together, and within a run in the order they had."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], g[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((g, h))
        a, b = h[order], g[order]
        same = a[1:] == a[:-1]
    return order, np.flatnonzero(np.concatenate([[True], ~(same & (b[1:] == b[:-1]))]))


def _deltas(starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Places, ascending within each of the documents that have ``counts`` of them, as steps."""
    steps = np.diff(starts, prepend=0)
    first = np.cumsum(counts) - counts
    steps[first] = starts[first]
    small = steps < 0xFFFF
    return np.where(small, steps, 0xFFFF).astype("<u2").tobytes() + steps[~small].astype("<i8").tobytes()


def _places(packed: bytes, counts: np.ndarray) -> np.ndarray:
    n = int(counts.sum())
    steps = np.frombuffer(packed, "<u2", n).astype(np.int64)
    steps[steps == 0xFFFF] = np.frombuffer(packed, "<i8", offset=2 * n)
    first = np.cumsum(counts) - counts
    total = np.cumsum(steps)
    return total - np.repeat(total[first] - steps[first], counts)


class Sender:
    """Rows of one task: windows by bucket, or repeats by home."""

    def __init__(self) -> None:
        self.zipper = zstandard.ZstdCompressor(level=1)

    def rows(self, key: np.ndarray, owner: np.ndarray, start: np.ndarray, owners: np.ndarray, *hashes: np.ndarray) -> Iterator[tuple]:
        """(key, owners, counts, starts, *hashes) for each key, of windows in the order of owners and starts."""
        order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
        key, owner, start = key[order], owner[order], start[order]
        hashes = tuple(h[order] for h in hashes)
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            heads = np.flatnonzero(np.diff(owner[lo:hi], prepend=-1))
            counts = np.diff(heads, append=hi - lo)
            mine = owners[owner[lo:hi][heads]]
            packed = (self.zipper.compress(x) for x in (mine.T.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _deltas(start[lo:hi], counts)))
            yield int(key[lo]), *packed, *(h[lo:hi].tobytes() for h in hashes)


def home_of(owners: np.ndarray, homes: int) -> np.ndarray:
    """The group of each document (id, hash of its text)."""
    return (mix(owners[:, 0].astype(np.int64).view(np.uint64) ^ mix(owners[:, 1].astype(np.int64).view(np.uint64))) % np.uint64(homes)).astype(np.int64)


def _table(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "home": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.binary())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def repeats(rows: DataFrame, width: int) -> DataFrame:
    """(id, th, spans): of the rows (id, th, text) the intervals of words to remove, as pairs of longs.

    ``th`` is a hash of the text, which tells documents of one id apart and orders them.
    """
    count, homes = 1 << max(partitions(rows, 4) - 1, 1).bit_length(), partitions(rows)
    last = np.uint64(count - 1)
    sent, found = [c.split()[0] for c in SENT.split(", ")], [c.split()[0] for c in FOUND.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sender, held, owners, size = Sender(), [], [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            who, rank = np.unique(np.array(owners, np.int64), axis=0, return_inverse=True)
            rank = rank.ravel()
            # a document that comes twice is one
            first = np.unique(rank, return_index=True)[1]
            mine = [held[i] for i in first.tolist()]
            lengths = np.array([len(x[0]) for x in mine])
            h, g = (np.concatenate(x) for x in zip(*mine, strict=True))
            owner = np.repeat(np.arange(len(mine)), lengths)
            start = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            order, runs = equal_runs(h, g)
            again = np.ones(len(h), bool)
            again[order[runs]] = False
            out = []
            if again.any():
                home = home_of(who, homes)[owner[again]]
                out += [(None, *r, None, None) for r in sender.rows(home, owner[again], start[again], who)]
            kept = ~again
            h, g = h[kept], g[kept]
            out += [(r[0], None, *r[1:]) for r in sender.rows((g & last).astype(np.int64), owner[kept], start[kept], who, h, (g >> np.uint64(48)).astype("<u2"))]
            for lo in range(0, len(out), 64):
                yield _table(sent, out[lo : lo + 64])

        for batch in batches:
            for key, th, text in zip(*map(strings, batch.columns), strict=True):
                h, g, _ = window_hashes(text, width)
                if len(h):
                    held.append((h, g))
                    owners.append((key, th))
                    size += len(h)
                if size >= FLUSH:
                    yield from flushed()
                    held, owners, size = [], [], 0
        if held:
            yield from flushed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sender, unzip, held, now = Sender(), zstandard.ZstdDecompressor(), [], None

        def added() -> Iterator[pa.RecordBatch]:
            h, g = (np.concatenate([np.frombuffer(x[i], kind) for x in held]) for i, kind in ((3, "<u8"), (4, "<u2")))
            order, runs = equal_runs(h, g)
            n = np.diff(runs, append=len(h))
            several = np.repeat(n > 1, n)
            at, group = order[several], np.repeat(np.arange(len(runs)), n)[several]
            del h, g, order, several
            if not len(at):
                return
            counts = [np.frombuffer(unzip.decompress(x[1]), "<u4").astype(np.int64) for x in held]
            owners = np.concatenate([np.frombuffer(unzip.decompress(x[0]), "<i8").reshape(2, -1).T for x in held])
            start = np.concatenate([_places(unzip.decompress(x[2]), c) for x, c in zip(held, counts, strict=True)])[at]
            who, rank = np.unique(owners, axis=0, return_inverse=True)
            owner = np.repeat(rank.ravel(), np.concatenate(counts))[at]
            order = np.lexsort((start, owner, group))
            group, owner, start = group[order], owner[order], start[order]
            same = group[1:] == group[:-1]
            # what comes after another of its group is a repeat, unless it is the same document's same place
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(head, append=len(group))
            late = (owner != np.repeat(owner[head], size)) | (start != np.repeat(start[head], size))
            owner, start = owner[late], start[late]
            if len(owner):
                order = np.lexsort((start, owner))
                owner, start = owner[order], start[order]
                out = list(sender.rows(home_of(who, homes)[owner], owner, start, who))
                for lo in range(0, len(out), 64):
                    yield _table(found, [(None, *r) for r in out[lo : lo + 64]])

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, home, *rest = (c[i].as_py() for c in batch.columns)
                if bucket is None:
                    yield _table(found, [(None, home, *rest[:3])])
                    continue
                if bucket != now and held:
                    yield from added()
                    held = []
                now = bucket
                held.append(rest)
        if held:
            yield from added()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        unzip, held, now = zstandard.ZstdDecompressor(), [], None

        def merged() -> Iterator[pa.RecordBatch]:
            counts = [np.frombuffer(unzip.decompress(x[1]), "<u4").astype(np.int64) for x in held]
            owners = np.concatenate([np.frombuffer(unzip.decompress(x[0]), "<i8").reshape(2, -1).T for x in held])
            start = np.concatenate([_places(unzip.decompress(x[2]), c) for x, c in zip(held, counts, strict=True)])
            who, rank = np.unique(owners, axis=0, return_inverse=True)
            owner = np.repeat(rank.ravel(), np.concatenate(counts))
            order = np.lexsort((start, owner))
            owner, start = owner[order], start[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + width)])
            head = np.flatnonzero(new)
            end = start[np.concatenate([head[1:], [len(start)]]) - 1] + width
            spans, of = np.stack([start[head], end], 1).astype("<i8"), owner[head]
            cuts = np.searchsorted(of, np.arange(len(who) + 1))
            for lo in range(0, len(who), 1024):
                some = range(lo, min(lo + 1024, len(who)))
                yield pa.RecordBatch.from_arrays([pa.array(who[lo : lo + 1024, 0]), pa.array(who[lo : lo + 1024, 1]), pa.array([spans[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())], names=["id", "th", "spans"])

        for batch in batches:
            for i in range(batch.num_rows):
                home, *rest = (c[i].as_py() for c in batch.columns[1:])
                if home != now and held:
                    yield from merged()
                    held = []
                now = home
                held.append(rest)
        if held:
            yield from merged()

    hashed = rows.mapInArrow(scan, SENT)
    # a repeat that is known already goes along with any bucket
    dealt = hashed.repartition(count, F.coalesce("bucket", F.pmod("home", F.lit(count)))).sortWithinPartitions("bucket")
    told = dealt.mapInArrow(add, FOUND)
    return told.repartition(homes, "home").sortWithinPartitions("home").mapInArrow(merge, "id long, th long, spans binary")


@F.arrow_udf(T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]))
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    lean()
    kept, size, removed, runs = [], [], [], []
    for t, s in zip(strings(text), strings(spans), strict=True):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        size.append(len(words))
        cuts = np.frombuffer(s, "<i8").reshape(-1, 2).tolist() if s else []
        for lo, hi in reversed(cuts):
            del words[lo:hi]
        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        removed.append(size[-1] - len(words))
        runs.append(len(cuts))
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in (size, removed, runs))], names=["kept", "n_words", "n_removed", "n_spans"])


def remove_windows(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``kept`` (the words that stay, joined by spaces), ``n_words``, ``n_removed`` and ``n_spans``.

    A word goes if a window of ``width`` words around it also starts earlier: in a document
    of smaller id, or earlier in its own.  A null text has no words.  A null id comes before
    all others; documents of one id with different texts are ordered by a hash of the text,
    and rows with the same id and text are one document and lose the same words.  Texts
    shorter than a window stay whole.  Columns named like the new ones are replaced; all
    others, the text too, are as they were.  A text of any length is one value: a task holds
    it, its words and their hashes.  No rows give no rows.
    """
    key, th, cut, spans = (fresh(docs, c) for c in ("id", "th", "cut", "spans"))
    text, paths = F.col(text_col).cast("string"), []
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), th: F.xxhash64(text)})
    found = written(repeats(keyed.select(F.col(key).alias("id"), F.col(th).alias("th"), text.alias("text")), width), "windows", paths)
    found = found.select(F.col("id").alias(key), F.col("th").alias(th), F.col("spans").alias(spans))
    out = keyed.join(found.hint("shuffle_hash"), [key, th], "left").withColumn(cut, _cut(text, spans))
    return out.withColumns({c: F.col(f"{cut}.{c}") for c in ("kept", "n_words", "n_removed", "n_spans")}).drop(key, th, cut, spans)
