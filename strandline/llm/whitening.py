"""Whitening of embeddings: principal components of exactly centred integer vectors.

Entries become integers, so that the mean of n vectors is a sum of integers over n and
``n * x - S`` is exact.  Each distinct vector counts once.  Its centred rows are a
``RowMatrix`` whose Gramian, summed by the executors, is as large as the dimension squared;
that alone is decomposed on the driver.  Components, sums and scales are broadcast, and
rows are projected in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import fresh, remove, written

#: Entries are cut at this size, which no sum of two leaves the longs with.
LARGEST = 1 << 61
#: Rows projected at a time; the share of the largest eigenvalue below which a component has no variance.
ROWS, LEAST = 4096, 1e-13
WORD = (1 << 32) - 1


@dataclass
class Whitening:
    """``components`` has a unit vector a row, by falling ``variance``; None where a component has no variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def live(self) -> np.ndarray:
        return self.variance > (LEAST * self.variance.max(initial=0.0))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S, the same over n): the first exact, as longs or, where they don't suffice, Python's integers."""
        rough = np.abs(x.astype(float) * self.n - np.array([float(s) for s in self.sums]))
        small = np.abs(x.astype(float)).max(initial=0.0) * self.n < 2.0**62 and rough.max(initial=0.0) < 2.0**62
        whole = x * np.int64(self.n) - np.array(self.sums, np.int64) if small else x.astype(object) * self.n - np.array(self.sums, object)
        return whole, (whole / self.n).astype(float)

    def whiten(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """(deviation, whitened) of rows of integers; a deviation that no long holds is None."""
        whole, centred = self.centred(x)
        rough = (centred * self.n) ** 2
        if whole.dtype != object and rough.sum(1).max(initial=0.0) < 2.0**62:
            deviation = (whole * whole).sum(1).tolist()
        else:
            deviation = [d if (d := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in whole]
        live = self.live()
        out = np.full((len(x), len(self.variance)), np.nan)
        out[:, live] = centred @ self.components[live].T / np.sqrt(self.variance[live])
        return deviation, out


def integers(embedding: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry; null if the vector is null or an entry null or not finite."""
    usable = embedding.isNotNull() & F.forall(embedding, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * 64, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + 1_000_000
    return F.when(usable, F.transform(embedding, whole))


def _matrix(vectors: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(column).alias("v")), "v"))


def _sums(fit: DataFrame, dims: int) -> list[int]:
    """Sums by dimension: of both halves of each entry, by task first, so that no long overflows."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, dims), np.int64)
            high += (x >> 32).sum(0)
            low += (x & WORD).sum(0)
        yield pd.DataFrame({"at": np.arange(dims), "high": high, "low": low})

    found = fit.mapInPandas(part, "at int, high long, low long").groupBy("at").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    of = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in found.collect()}  # a row a dimension
    return [of[i] for i in range(dims)]


def fit(vectors: DataFrame, x: str = "x", most: int = 16) -> Whitening | None:
    """The first ``most`` components of the distinct vectors of the array column ``x``; None without vectors.

    Of vectors of several lengths those of the most frequent length count, of equally
    frequent ones the longest.  Eigenvectors have their largest entry positive.  A component
    without variance is kept, but nothing is divided by its scale.
    """
    spark, paths = vectors.sparkSession, []
    lengths = vectors.where(F.col(x).isNotNull()).groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return None
    dims = lengths[0]["d"]
    fitted = written(vectors.where(F.size(x) == dims).select(F.col(x).alias("x")).distinct(), "vectors", paths)
    n = fitted.count()
    model = Whitening(n, _sums(fitted, dims), np.zeros((0, dims)), np.zeros(0), np.zeros(0), None)
    shared = spark.sparkContext.broadcast(model)

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                yield pd.DataFrame({"v": list(shared.value.centred(np.stack(batch["x"].to_numpy()[lo : lo + ROWS]))[1])})

    gram = _matrix(fitted.mapInPandas(centred, "v array<double>"), "v").computeGramianMatrix().toArray() / n
    values, vectors_ = np.linalg.eigh(gram)
    order = np.argsort(-values, kind="stable")[: min(most, dims)]
    components = vectors_[:, order].T
    components = components * np.sign(components[np.arange(len(order)), np.abs(components).argmax(1)])[:, None]
    variance, trace = np.maximum(values[order], 0.0), float(np.trace(gram))
    model = Whitening(n, model.sums, components, variance, variance / trace if trace > 0 else np.full(len(order), np.nan), None)
    live = model.live()
    if live.any():
        whole = spark.sparkContext.broadcast(model)

        def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo in range(0, len(batch), ROWS):
                    yield pd.DataFrame({"v": list(whole.value.whiten(np.stack(batch["x"].to_numpy()[lo : lo + ROWS]))[1][:, whole.value.live()])})

        covariance = _matrix(fitted.mapInPandas(projected, "v array<double>"), "v").computeGramianMatrix().toArray() / n
        model.identity_error = float(np.abs(covariance - np.eye(int(live.sum()))).max())
    for path in paths:
        remove(spark, path)
    return model


def whiten(rows: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of each usable row; the arrays have an entry a component.

    Rows whose vector is null, or holds null, infinite or missing numbers, or whose length
    isn't that of ``fit``, go.  Repeated rows and rows without an id come out as they went
    in; equal vectors count once in the fit.  ``whitened`` is null for a component without
    variance, ``identity_error`` if none has any; a ``deviation`` beyond a long is null, and
    entries beyond 2**55 are cut there.  Other columns go.  No usable rows give no rows.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType
    own = rows.select(F.col(id_col).cast("string").alias("id"), integers(F.col(vector_col)).alias("x")).where(F.col("x").isNotNull())
    schema = "id string, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    model = fit(own, "x", most)
    if model is None:
        return spark.createDataFrame([], schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        explained = [None if np.isnan(v) else float(v) for v in m.explained]
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.iloc[lo : lo + ROWS]
                deviation, out = m.whiten(np.stack(part["x"].to_numpy()))
                live = m.live()
                whitened = list(out) if live.all() else [[float(v) if k else None for v, k in zip(r, live, strict=True)] for r in out]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": m.n, "deviation": pd.array(deviation, "Int64"), "whitened": whitened, "explained": [explained] * len(part), "identity_error": m.identity_error})

    out = own.where(F.size("x") == model.dims).mapInPandas(project, schema)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    at = fresh(whitened, "at")
    long = whitened.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias(at, "entry"))
    return long.select(id_col, (F.col(at) + 1).cast("int").alias("component"), "n", "deviation", F.col("entry.whitened").alias("whitened"), F.col("entry.explained").alias("explained"), "identity_error")
