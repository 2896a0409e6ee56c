"""A Markov model of order k over ACGT: counts, and generation by hashes instead of a random stream."""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import gc_bin, gc_count, reverse_complement
from strandline.operators.sampling import take_by_hash


def run_counts(seqs: DataFrame, length: int, seq: str = "seq") -> DataFrame:
    """(run, n): runs of so many letters, counted within each batch and summed; a null sequence has none."""
    k = length - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: collections.Counter = collections.Counter()
            for lo in range(0, batch.num_rows, 512):
                texts = [t for t in batch.column(0).slice(lo, 512).to_pylist() if t and len(t) > k]
                if not texts:
                    continue
                letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                ends = np.cumsum([len(t) for t in texts])
                whole = np.ones(len(letters) - k, bool)
                for i in range(1, k + 1):  # runs that would cross from one sequence to the next
                    whole[ends[:-1] - i] = False
                names, where = np.unique(letters, return_inverse=True)
                code = np.zeros(len(whole), np.int64)
                for i in range(k + 1):
                    code = code * len(names) + where[i : i + len(whole)]
                found, n = np.unique(code[whole], return_counts=True)
                spelled = ["".join(chr(names[c // len(names) ** (k - i) % len(names)]) for i in range(k + 1)) for c in found.tolist()]
                total.update(dict(zip(spelled, n.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["run", "n"])

    return seqs.select(F.col(seq).cast("string")).mapInArrow(count, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


def transitions(seqs: DataFrame, k: int = 5, seq: str = "seq") -> DataFrame:
    """(state, next, n) over both strands; a sequence of w letters has w - k transitions a strand.

    The other strand's runs are the reverse complements of the same ones.
    """
    runs = run_counts(seqs, k + 1, seq)
    both = runs.select(F.explode(F.array(F.col("run"), reverse_complement(F.col("run")))).alias("run"), "n")
    return both.groupBy(F.substring("run", 1, k).alias("state"), F.substring("run", k + 1, 1).alias("next")).agg(F.sum("n").alias("n"))


def initials(seqs: DataFrame, k: int = 5, seq: str = "seq") -> DataFrame:
    """(state, n): the first k letters, over both strands."""
    both = seqs.select(F.explode(F.array(F.col(seq), reverse_complement(F.col(seq)))).alias("s")).where(F.length("s") >= k)
    return both.groupBy(F.substring("s", 1, k).alias("state")).agg(F.count("*").alias("n"))


def numbers(trans: DataFrame, init: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(transitions[4**k, 4], initials[4**k]): counts by the states' base-4 numbers, a pseudocount of 1 on transitions.

    The driver reads 4 ** (k + 1) and 4 ** k rows at most; other letters have no state.
    """
    code = lambda w: reduce(lambda c, x: c * 4 + "ACGT".index(x), w, 0)
    plain = lambda w: len(w) > 0 and not set(w) - set("ACGT")
    counts, first = np.ones((4**k, 4), np.int64), np.zeros(4**k, np.int64)
    for r in trans.where(F.length("state") == k).collect():
        if plain(r["state"]) and plain(r["next"]):
            counts[code(r["state"]), code(r["next"])] += r["n"]
    for r in init.collect():
        if plain(r["state"]):
            first[code(r["state"])] += r["n"]
    return counts, first


def draws(seed: str, row: int, width: int) -> np.ndarray:
    """``width`` numbers below 2**32: the words, big-endian, of sha256 of seed:row:block, eight a block."""
    blocks = b"".join(hashlib.sha256(f"{seed}:{row}:{i}".encode()).digest() for i in range(-(-width // 8)))
    return np.frombuffer(blocks, ">u4")[:width].astype(np.int64)


def scaled(u: np.ndarray, total: np.ndarray) -> np.ndarray:
    """u * total // 2**32 of u below 2**32 and totals below 2**53, without overflow."""
    u, total = u.astype(np.uint64), total.astype(np.uint64)
    return (u * (total >> np.uint64(32)) + (u * (total & np.uint64(0xFFFFFFFF)) >> np.uint64(32))).astype(np.int64)


def generate(trans: DataFrame, init: DataFrame, n: int, width: int, k: int = 5, seed: str = "42") -> DataFrame:
    """(row, seq): n sequences; transitions have a pseudocount of 1, initial states none.

    Letter i of a row is drawn by number i of ``draws(seed, row)``, so that a lost task
    draws the same again and SQL can draw it too; the first number draws the initial state.
    A number u stands for the first letter whose running count c of a total t has
    u * t < c * 2**32.  Rows of a batch go side by side, letter by letter.  The model is
    bounded by 4 ** (k + 1) counts; without initial states there are no rows.
    """
    spark = trans.sparkSession
    counts, first = numbers(trans, init, k)
    sent = spark.sparkContext.broadcast((np.cumsum(counts, axis=1), np.cumsum(first)))  # bounded by 4 ** (k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto, starts = sent.value
        for batch in batches:
            rows = batch.column(0).to_pylist()
            u = np.array([draws(seed, row, width - k + 1) for row in rows], np.int64).reshape(len(rows), -1)
            if not len(rows) or not starts[-1]:
                continue
            state = np.searchsorted(starts, scaled(u[:, 0], starts[-1:]), side="right")
            out = np.empty((len(rows), width), np.uint8)
            for i in range(k):
                out[:, i] = state >> 2 * (k - 1 - i) & 3
            for i in range(width - k):
                at = upto[state]
                x = (scaled(u[:, i + 1, None], at[:, 3:]) >= at[:, :3]).sum(1)
                out[:, k + i] = x
                state = (state << 2 & 4**k - 1) | x
            seqs = [x.tobytes().decode() for x in np.frombuffer(b"ACGT", np.uint8)[out]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.string())], names=["row", "seq"])

    return spark.range(n).select(F.col("id").alias("row")).mapInArrow(run, "row long, seq string")


def matched_to(rows: DataFrame, hist: DataFrame, n: int, width: int, bins: int = 50) -> DataFrame:
    """Generated rows whose GC bins follow a histogram (bin, frac)."""
    binned = rows.withColumn("bin", gc_bin(gc_count(F.col("seq")), F.lit(width), bins))
    quota = hist.select("bin", F.rint(F.col("frac") * n).cast("bigint").alias("quota")).where("quota > 0")
    return take_by_hash(binned, ["bin"], "row", quota)
