"""Features for probes: k-mer vectors, standardization, cosine parity, and the probes themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kmer_vector(seq: Column, k: int = 3) -> Column:
    """Counts of all 4**k words in alphabetical order, as floats; words with other letters count to none.

    Null gives null.  In Arrow batches, as there is no built-in function that counts into
    an array by number: one that filters the words goes through them 4**k times.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(seqs: pa.Array) -> pa.Array:
        number = np.full(256, -1, np.int64)
        number[list(b"ACGT")] = range(4)
        out = []
        for s in seqs:
            if (text := s.as_py()) is None:
                out.append(None)
                continue
            letters = number[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
            n = max(len(letters) - k + 1, 0)
            code, plain = np.zeros(n, np.int64), np.ones(n, bool)
            for i in range(k if n else 0):
                code, plain = code * 4 + letters[i : i + n], plain & (letters[i : i + n] >= 0)
            out.append(np.bincount(code[plain], minlength=4**k).astype(np.float32))
        return pa.array(out, pa.list_(pa.float32()))

    return vectors(seq)


def kmer_counts(df: DataFrame, id_col: str, seq: str, k: int = 3) -> DataFrame:
    """(id, kmer, n).

    A sequence's words are counted in Arrow batches, so that a row for each word that occurs
    is made and summed, not one for each place; a null sequence has none.
    """
    of = T.ArrayType(T.StructType([T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())]))

    @F.arrow_udf(of)
    def counted(seqs: pa.Array) -> pa.Array:
        names, counts, ends = [], [], [0]
        for s in seqs:
            letters = np.frombuffer((s.as_py() or "").encode("utf-32-le"), np.uint32)
            kinds, where = np.unique(letters, return_inverse=True)
            code = np.zeros(max(len(letters) - k + 1, 0), np.int64)
            for i in range(k if len(code) else 0):
                code = code * len(kinds) + where[i : i + len(code)]
            found, n = np.unique(code, return_counts=True)
            spelled = kinds[found[:, None] // len(kinds) ** np.arange(k - 1, -1, -1) % len(kinds)] if len(found) else np.zeros((0, k), np.uint32)
            names += [x.tobytes().decode("utf-32-le") for x in spelled]
            counts.append(n)
            ends.append(len(names))
        rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["kmer", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    own = df.select(id_col, F.explode(counted(F.col(seq).cast("string"))).alias("w"))
    return own.groupBy(id_col, F.col("w.kmer").alias("kmer")).agg(F.sum("w.n").alias("n"))


def moments(df: DataFrame, vector: str, floor: float = 1e-6) -> DataFrame:
    """(dim, mean, std) of the rows to train on; the population's deviation, 1e-6 at least."""
    at = df.select(F.posexplode(vector).alias("dim", "x"))
    return at.groupBy("dim").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("std"))


def standardized(df: DataFrame, vector: str, stats: DataFrame) -> DataFrame:
    """The vectors less the mean, over the deviation; the statistics are one row of two arrays."""
    row = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))), lambda s: F.struct(s["mean"].alias("mean"), s["std"].alias("std"))).alias("__stats"))
    out = df.crossJoin(F.broadcast(row))  # one row, as long as a vector
    return out.withColumn(vector, F.zip_with(vector, "__stats", lambda x, s: (x - s["mean"]) / s["std"])).drop("__stats")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either has no length."""
    under = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(under == 0, 0.0).otherwise(dot(a, b) / under)


def parity(df: DataFrame, a: str, b: str, least: float = 0.999) -> DataFrame:
    """(least, mean, ok) of the cosines of two vectors of each row."""
    return df.agg(F.min(cosine(a, b)).alias("least"), F.avg(cosine(a, b)).alias("mean")).withColumn("ok", F.col("least") >= least)


def half_range(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vectors don't fit 16-bit floats or aren't finite."""
    return df.where(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 65504)))


def logistic_grid(train: DataFrame, dev: DataFrame, grid: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0), vector: str = "features", label: str = "label"):
    """(model, C, rows of figures): the first grid value of the best rounded MCC on dev.

    The penalty is 1 / (C n) on features that are standardized already.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from strandline.operators.evaluation import binary

    own = lambda x: x.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    n, best, rows = train.count(), None, []
    prepared, tune = own(train).persist(), own(dev).persist()
    for c in grid:
        model = LogisticRegression(featuresCol="__v", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10).fit(prepared)
        scored = model.transform(tune).withColumn("prob", vector_to_array("probability")[1])
        mcc = binary(scored, [], 0.5, label).first()["mcc"]
        rows.append((c, mcc))
        if best is None or mcc > best[2]:
            best = (model, c, mcc)
    prepared.unpersist()
    tune.unpersist()
    return best[0], best[1], rows


def mlp_probe(train: DataFrame, dims: int, hidden: int = 256, vector: str = "features", label: str = "label", seed: int = 42):
    """A perceptron with one hidden layer.  Spark's has sigmoid units and no penalty, so its figures are its own."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    own = train.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return MultilayerPerceptronClassifier(featuresCol="__v", labelCol=label, layers=[dims, hidden, 2], seed=seed, maxIter=100).fit(own)
