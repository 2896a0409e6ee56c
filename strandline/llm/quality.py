"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

The statistics of a text are standardized and mapped to ``sqrt(2/D) cos(Wx + b)``, whose
inner products approximate a Gaussian kernel.  Ridge weights come from normal equations
that partitions sum up, each for its rows.  Folds 0 and 1 of crc32(doc_id as text) mod 4
fit the weights and fold 3 the calibration; fold 2 is never learned from.  The fit uses a
bounded sample of labelled rows (``max_rows``); scoring is one scan of all texts without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.shared import fold, strings, written

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = 18 + len(MARKS)
LOWER, UPPER, DIGIT = (np.frombuffer(bytes(range(a, b)), np.uint8) for a, b in ((97, 123), (65, 91), (48, 58)))


def statistics(text: str | None) -> np.ndarray:
    """Figures of a whole text: shares of kinds of bytes and of each mark, words, lines, repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(STATISTICS)
    n = len(data)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / n
    seen = share[share > 0]
    words = data.split()
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = data.split(b"\n")
    filled = [x for x in lines if x]
    ends = np.bincount(np.fromiter((w[-1] for w in words), np.uint8, len(words)), minlength=256) if words else np.zeros(256)
    letters = share[LOWER].sum() + share[UPPER].sum() + share[128:].sum()
    out[:18] = (
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        share[LOWER].sum(),
        share[UPPER].sum(),
        share[128:].sum(),
        share[DIGIT].sum(),
        share[32] + share[9:14].sum(),
        -(seen * np.log2(seen)).sum(),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(set(words)) / max(len(words), 1),
        np.log1p(n / len(lines)),
        len(set(filled)) / max(len(filled), 1),
        share[UPPER].sum() / max(letters, 1e-9),
        (ends[LOWER].sum() + ends[UPPER].sum() + ends[128:].sum()) / max(len(words), 1),
        1 - letters,
    )
    out[18:] = np.sqrt(share[np.frombuffer(MARKS, np.uint8)])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # their calibrated scores

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the blocks' centres and their means, to be joined by lines."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
        blocks.append([y, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    y, n, s = np.array(blocks).T
    return s / n, y / n


def _batches(rows: DataFrame, model: Model | None) -> DataFrame:
    """Each partition's sums: of x and its squares without a model, else the normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = STATISTICS if model is None else len(model.weights)
        sums, n = np.zeros((2, d) if model is None else (d, d + 1)), 0
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), np.float64)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                if model is None:
                    sums += np.stack([x.sum(0), (x * x).sum(0)])
                else:
                    z = model.features(x)
                    sums += np.hstack([z.T @ z, (z.T @ y)[:, None]])
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["sums", "n"])

    return rows.select("x", "y").mapInArrow(run, "sums binary, n long")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, features: int = 256, ridge: float = 1e-3, width: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """None if there is no labelled row to learn from.  Null ids, labels and repeated label rows are passed over."""
    own = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("double").alias("y")).where("key IS NOT NULL AND y IS NOT NULL").where(fold(F.col("key")) != 2)
    # a bounded sample of labelled rows, by hash of the id
    own = own.dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(own), "key")  # max_rows rows at most
    kind = T.ArrayType(T.DoubleType())

    @F.arrow_udf(kind)
    def figures(text: pa.Array) -> pa.Array:
        return pa.array([statistics(t).tolist() for t in strings(text)], pa.list_(pa.float64()))

    # the scan keeps its tasks; max_rows rows at most are dealt to few files
    rows = written(rows.select("key", "y", figures("text").alias("x")).repartition(16, "key"), "quality")
    learn, calibrate = rows.where(fold(F.col("key")) != 3), rows.where(fold(F.col("key")) == 3)
    sums = [(np.frombuffer(bytes(r["sums"])).reshape(2, -1), r["n"]) for r in _batches(learn, None).collect()]
    n = sum(x[1] for x in sums)
    if not n:
        return None
    mean = sum(x[0][0] for x in sums) / n
    scale = np.sqrt(np.maximum(sum(x[0][1] for x in sums) / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    draw = np.random.default_rng(seed)
    model = Model(mean, scale, draw.normal(size=(STATISTICS, features)) * width / np.sqrt(STATISTICS), draw.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))
    normal = sum(np.frombuffer(bytes(r["sums"])).reshape(features + 1, -1) for r in _batches(learn, model).collect())
    model.weights = np.linalg.solve(normal[:, :-1] + ridge * n * np.eye(features + 1) / features, normal[:, -1])
    held = calibrate.select("x", "y").toPandas()
    held = held if len(held) else learn.select("x", "y").toPandas()
    model.knots, model.levels = isotonic(model.raw(np.array(held["x"].tolist())), held["y"].to_numpy())
    model.levels = np.clip(model.levels, 0, 1)
    return model


def score(text: Column, model: Model | None) -> Column:
    """The calibrated score of a whole text; a null or empty one has a score too.  Without a model it is 1."""
    if model is None:
        return F.lit(1.0)

    @F.arrow_udf(T.DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in strings(text)]).reshape(-1, STATISTICS)
        return pa.array(np.clip(model.score(x), 0, 1))

    return scored(text.cast("string"))
