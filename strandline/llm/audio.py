"""Chroma fingerprints of an audio column, and alignment of recordings by offset histograms.

A recording's spectrum is folded to twelve pitch classes, frame by frame.  Sixteen
rectangle filters, summed by an integral image over 16 frames, give two bits each: one
packed integer of 32 bits a frame.  Two recordings are aligned where most of their equal
integers agree on the offset; the share of bits that differ there decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.shared import strings, written

RATE, FRAME, HOP, WINDOW = 5512, 2048, 683, 16
LOWEST, HIGHEST = 55.0, 2500.0
#: (kind, first pitch class, pitch classes, frames): kinds compare halves by pitch, halves by time, quarters crosswise, the middle third by pitch, the middle third by time.
FILTERS = [(j % 5, (5 * j) % 7, 6, WINDOW - 4 * (j % 3 == 2)) for j in range(16)]
#: Two bits by thirds of a filter's value, as a Gray code, so that small changes turn one bit.
STEP, GRAY = 0.12, np.array([0, 1, 3, 2], np.uint32)
#: A print is looked up by three of its four bytes, in all four ways.
MASKS = [np.uint32(0xFFFFFFFF ^ 0xFF << 8 * i) for i in range(4)]
#: Frames that are transformed at a time.
FRAMES = 512
#: Pairs of prints that are counted at a time.
PAIRS = 1 << 20
QUERY_BLOCK = 4096


def _chroma_bins(rate: int) -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    ok = (f >= LOWEST) & (f <= HIGHEST)
    out = np.zeros((len(f), 12), np.float32)
    out[np.flatnonzero(ok), np.round(12 * np.log2(f[ok] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """[frames, 12] energies by pitch class, smoothed over five frames, of length 1 each or silent."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    at = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, hann = _chroma_bins(rate), np.hanning(FRAME).astype(np.float32)
    # some frames at a time: a long recording needs little beside its samples and twelve numbers a frame
    frames = np.concatenate([np.abs(np.fft.rfft(at[i : i + FRAMES] * hann, axis=1)) ** 2 @ bins for i in range(0, len(at), FRAMES)]).astype(np.float64)
    padded = np.vstack([np.zeros((2, 12)), frames, np.zeros((2, 12))])
    smooth = sum(w * padded[i : i + len(frames)] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    return np.where(norm > 1e-6 * FRAME, smooth / np.maximum(norm, 1e-12), 0)


def prints(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """A packed integer (uint32) for each run of 16 frames; none for a shorter recording."""
    frames = chroma(samples, rate)
    n = len(frames) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    i = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[i + t1, p1] - image[i + t0, p1] - image[i + t1, p0] + image[i + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        whole = area(0, w, p, p + h)
        if kind == 0:
            a = area(0, w, p, p + h // 2)
        elif kind == 1:
            a = area(0, w // 2, p, p + h)
        elif kind == 2:
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        elif kind == 3:
            a = area(0, w, p + h // 3, p + 2 * h // 3)
        else:
            a = area(w // 3, 2 * w // 3, p, p + h)
        value = np.log((1 + a) / (1 + whole - a)) + (np.log(2) * 0.5 if kind > 2 else 0)
        out = out << np.uint32(2) | GRAY[(value > -STEP).astype(int) + (value > 0) + (value > STEP)]
    return out


def samples(audio: bytes) -> np.ndarray:
    """16-bit little-endian mono samples."""
    return np.frombuffer(audio, "<i2", len(audio) // 2)


def played(vector: list[float | None], note: float = 0.125) -> np.ndarray:
    """Samples of a clip that plays a vector: a note for each component, whose pitch follows its value."""
    x = np.nan_to_num(np.array([0 if c is None else c for c in vector], np.float32))
    f = 220 * 2 ** (((7 * np.arange(len(x))) % 12 + 24 * np.clip(x, -1, 1)) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * f / RATE, round(note * RATE))).astype(np.float32)
    return (12000 * np.sin(phase) + 5000 * np.sin(2 * phase)).astype("<i2")


def fingerprint(audio: Column, rate: int = RATE, decode: Callable[[object], np.ndarray] = samples) -> Column:
    """array<int> of an audio column, which ``decode`` turns into samples, one recording at a time.

    Null for null, empty for less than 16 frames.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def made(audio: pa.Array) -> pa.Array:
        return pa.array([None if a is None else prints(decode(a), rate).view(np.int32) for a in strings(audio, 16)], pa.list_(pa.int32()))

    return made(audio)


@dataclass
class Queries:
    """Postings of a block of query classes, by each of the masks."""

    classes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    flat: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    values: list[np.ndarray]
    orders: list[np.ndarray]


def postings(classes: list[int], fingerprints: list[np.ndarray]) -> Queries:
    lengths = np.array([len(f) for f in fingerprints], np.int64)
    flat = np.concatenate(fingerprints).view(np.uint32)
    owner = np.repeat(np.arange(len(classes)), lengths)
    starts = np.cumsum(lengths) - lengths
    orders = [np.argsort(flat & m, kind="stable") for m in MASKS]
    return Queries(np.array(classes, np.int64), starts, lengths, flat, owner, np.arange(len(flat)) - starts[owner], [(flat & m)[o] for m, o in zip(MASKS, orders, strict=True)], orders)


def _votes(prints: np.ndarray, q: Queries, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(query * span + offset + span // 2, ascending; votes): for each mask, each pair of prints that are equal under it has a vote.

    Pairs are counted a bounded number at a time, so that a print that a recording and the
    queries have very often (silence) costs time, not memory.
    """
    keys, votes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def counted() -> None:
        nonlocal keys, votes, held, size
        found, n = np.unique(np.concatenate(held), return_counts=True)
        both, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
        keys, votes = both, np.bincount(where, np.concatenate([votes, n]), minlength=len(both)).astype(np.int64)
        held, size = [], 0

    for mask, values, order in zip(MASKS, q.values, q.orders, strict=True):
        lo, hi = (np.searchsorted(values, prints & mask, side=s) for s in ("left", "right"))
        at = 0
        while at < len(prints):
            upto = np.cumsum(hi[at:] - lo[at:])
            if upto[0] > PAIRS:  # one print with many postings
                end = at + 1
                parts = [(np.full(min(PAIRS, int(hi[at]) - x), at), order[x : min(x + PAIRS, int(hi[at]))]) for x in range(int(lo[at]), int(hi[at]), PAIRS)]
            else:
                end = at + max(int(np.searchsorted(upto, PAIRS, side="right")), 1)
                n = hi[at:end] - lo[at:end]
                parts = [(np.repeat(np.arange(at, end), n), order[np.repeat(lo[at:end] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])]
            for place, own in parts:
                held.append(q.owner[own] * span + place - q.place[own] + span // 2)
                size += len(own)
                if size >= PAIRS:
                    counted()
            at = end
    if len(keys):
        counted()
        return keys, votes
    return np.unique(np.concatenate(held), return_counts=True) if held else (keys, votes)


def _wrong_bits(prints: np.ndarray, q: Queries, query: np.ndarray, offset: np.ndarray, first: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Differing bits where each query overlaps, some overlaps at a time."""
    out = np.zeros(len(query), np.int64)
    ends = np.cumsum(overlap)
    lo = 0
    while lo < len(query):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = overlap[lo:hi]
        rows = np.repeat(np.arange(lo, hi), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[rows]
        bits = np.bitwise_count(prints[place] ^ q.flat[q.starts[query][rows] + place - offset[rows]])
        out[lo:hi] = np.bincount(rows - lo, bits, minlength=hi - lo)
        lo = hi
    return out


def align(prints: np.ndarray, q: Queries, max_error: float, min_overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, offset, votes, share of differing bits) of the queries that a recording matches.

    Prints are equal under a mask if three of their four bytes are; so are one in three of
    prints with 8 % of wrong bits, and of 16 such prints one at least in 998 of 1,000 cases.
    """
    prints = prints.view(np.uint32)
    span = 2 * (len(prints) + int(q.lengths.max(initial=0))) + 2
    key, votes = _votes(prints, q, span)
    query, offset = key // span, key % span - span // 2
    if not len(query):
        return query, offset, votes, np.zeros(0)
    # the offset with most votes, the smaller of equals
    begin = np.flatnonzero(np.diff(query, prepend=-1))
    most = votes == np.repeat(np.maximum.reduceat(votes, begin), np.diff(begin, append=len(query)))
    query, offset, votes = query[most], offset[most], votes[most]
    order = np.lexsort((offset, np.abs(offset), query))
    order = order[np.diff(query[order], prepend=-1) > 0]
    query, offset, votes = query[order], offset[order], votes[order]
    first, last = np.maximum(offset, 0), np.minimum(len(prints), offset + q.lengths[query])
    overlap = last - first
    wrong = _wrong_bits(prints, q, query, offset, first, overlap)
    error = wrong / np.maximum(32 * overlap, 1)
    ok = (error <= max_error) & (overlap >= np.minimum(min_overlap, np.minimum(len(prints), q.lengths[query])))
    return query[ok], offset[ok], votes[ok], error[ok]


def _rows(recordings: DataFrame, is_query: Column, id_col: str, prints_col: str) -> DataFrame:
    rows = recordings.select(F.col(id_col).cast("long").alias("id"), F.col(prints_col).alias("prints"), (F.coalesce(is_query, F.lit(False)) & F.col(id_col).isNotNull()).alias("is_query"))
    return written(rows.withColumn("key", F.when(F.size("prints") > 0, F.sha2(F.array_join("prints", ",").cast("binary"), 256))), "prints")


def _matches(rows: DataFrame, max_error: float, min_overlap: int) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): pairs of (number, asking class_id, matched class_id and members, offset, error), written by the tasks."""
    spark = rows.sparkSession
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("members"), F.max("is_query").alias("asks"), F.first("prints").alias("prints"))
    classes = written(classes, "classes").withColumn("number", F.xxhash64("key"))
    names = ("number", "class_id", "members", "offset", "error")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    schema = "number long, class_id long, members long, offset long, error double"

    def block(q: Queries) -> DataFrame:
        sent = spark.sparkContext.broadcast(q)  # QUERY_BLOCK classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            for batch in batches:
                for number, class_id, members, prints in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    query, offset, _, error = align(np.array(prints, np.int32), q, max_error, min_overlap)
                    other = q.classes[query] != number
                    if other.any():
                        n = int(other.sum())
                        columns = (q.classes[query][other], [class_id] * n, [members] * n, offset[other], error[other])
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        return classes.select("number", "class_id", "members", "prints").mapInArrow(run, schema)

    found, numbers, fingerprints = [], [], []
    for r in classes.where("asks").select("number", "prints").toLocalIterator():
        numbers.append(r["number"])
        fingerprints.append(np.array(r["prints"], np.int32))
        if len(numbers) == QUERY_BLOCK:
            found.append(written(block(postings(numbers, fingerprints)), "pairs"))
            numbers, fingerprints = [], []
    if numbers:
        found.append(written(block(postings(numbers, fingerprints)), "pairs"))
    pairs = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return classes, pairs


def match_pairs(recordings: DataFrame, is_query: Column, max_error: float = 0.08, min_overlap: int = 16, id_col: str = "id", prints_col: str = "prints") -> DataFrame:
    """(query_class, class_id, members, offset, error): every class that a query's class matches, itself with offset and error 0 if others have its prints.

    ``search`` has each recording's class, so that the members of both sides are one join away.
    A class without any id has a null class_id.
    """
    classes, pairs = _matches(_rows(recordings, is_query, id_col, prints_col), max_error, min_overlap)
    asks = classes.where("asks")
    own = asks.where("members > 1").select(F.col("class_id").alias("query_class"), "class_id", "members", F.lit(0).cast("long").alias("offset"), F.lit(0.0).alias("error"))
    return pairs.join(asks.select("number", F.col("class_id").alias("query_class")), "number").select("query_class", "class_id", "members", "offset", "error").union(own)


def search(recordings: DataFrame, is_query: Column, max_error: float = 0.08, min_overlap: int = 16, id_col: str = "id", prints_col: str = "prints") -> DataFrame:
    """One row per recording: class, number of prints, and for queries how many others match and the best of them.

    Recordings with equal prints are one class, named by its smallest id, and match each
    other; classes are aligned, not their members.  Queries are read in blocks of
    ``QUERY_BLOCK`` classes, and each block is held against all classes; the count and the
    best are derived from the pairs of classes, which ``match_pairs`` returns.  The best of a
    query with copies is the copy of smallest id; else that of least error, and of equal ones
    the smallest id.  Of offsets with equal votes the smallest is taken, the negative one of
    two.  A recording without prints (null, or too
    short) has no class and no match.  Rows with a null id are no queries.  Repeated rows
    are members each.
    """
    rows = _rows(recordings, is_query, id_col, prints_col)
    classes, pairs = _matches(rows, max_error, min_overlap)
    best = F.min(F.struct("error", F.col("class_id").isNull().alias("none"), F.col("class_id").alias("best_id"), F.col("offset").alias("best_offset")))
    sums = pairs.groupBy("number").agg(F.sum("members").alias("links"), best.alias("best"))
    copies = rows.join(classes.where("asks AND members > 1").select("key", "class_id"), "key").groupBy("key").agg(F.min(F.when(F.col("id") > F.col("class_id"), F.col("id"))).alias("second"), F.count_if(F.col("id") == F.col("class_id")).alias("firsts"))
    out = classes.select("key", "class_id", "members", "number").join(sums, "number", "left").join(copies, "key", "left")
    asked = lambda x: F.when(F.col("is_query"), x)
    copy = F.when((F.col("id") > F.col("class_id")) | (F.col("firsts") > 1), F.col("class_id")).otherwise(F.col("second"))
    own = F.when(F.col("members") > 1, F.struct(F.lit(0.0).alias("error"), copy.isNull().alias("none"), copy.alias("best_id"), F.lit(0).cast("long").alias("best_offset")))
    joined = rows.join(out, "key", "left").withColumn("best", F.coalesce(own, F.col("best")))
    return joined.select(
        "id",
        "class_id",
        F.when(F.col("prints").isNull(), 0).otherwise(F.size("prints")).alias("n_prints"),
        "is_query",
        asked(F.coalesce("links", F.lit(0)) + F.coalesce(F.col("members") - 1, F.lit(0))).alias("n_links"),
        asked(F.col("best.best_id")).alias("best_id"),
        asked(F.col("best.best_offset")).alias("best_offset"),
        asked(F.col("best.error")).alias("best_error"),
    )
