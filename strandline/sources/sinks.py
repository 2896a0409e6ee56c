"""Writers: the dataset contract, predictions, embeddings, and publishing as a whole."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.sequence import fixed, only_acgt, reverse_complement
from strandline.sources.readers import CONTRACT


def contract_rows(windows: DataFrame, width: int) -> DataFrame:
    """Two rows per window, fwd then rc, with figures as text; a sequence of another length or alphabet is an error."""
    good = (F.length("seq") == width) & only_acgt(F.col("seq"))
    seq = F.when(good, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("bad sequence: "), F.col("window_id"))).cast("string"))
    both = windows.withColumn("o", F.explode(F.array(F.struct(F.lit("fwd").alias("orientation"), seq.alias("sequence")), F.struct(F.lit("rc").alias("orientation"), reverse_complement(seq).alias("sequence")))))
    out = both.select(
        "o.sequence",
        "label",
        "source",
        "detail",
        "window_id",
        "o.orientation",
        "chrom",
        "start",
        "end",
        "strand",
        "group",
        fixed(F.col("gc").cast("double") / width, 4).alias("gc"),
        fixed(F.col("max_id_train"), 4).alias("max_id_train"),
        fixed(F.col("max_id_train_local"), 4).alias("max_id_train_local"),
    )
    return out.select(*CONTRACT).orderBy("window_id", "orientation")


def prediction_rows(scored: DataFrame) -> DataFrame:
    return scored.select("window_id", "orientation", "source", "label", fixed(F.col("prob"), 6).alias("prob"), *(fixed(F.col(c), 4).alias(c) for c in ("max_id_train", "max_id_train_local")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def benchmark_prediction_rows(scored: DataFrame) -> DataFrame:
    """(sequence_id, label, pred, prob): the row's number in the test file, and the probability with six places."""
    return scored.select(F.col("row_idx").alias("sequence_id"), "label", "pred", fixed(F.col("prob"), 6).alias("prob"))


def index_rows(rows: DataFrame) -> DataFrame:
    """The columns that say which row an embedding is of; null figures are empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("row_idx", "window_id", "orientation", "label", "source", empty("max_id_train"), empty("max_id_train_local"))


def half_precision(df: DataFrame, vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """The vectors rounded to 16-bit floats (kept as 32-bit ones); another length, a null or a number beyond 65504 is an error."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def rounded(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            half = flat.astype(np.float16)
        if vectors.null_count or not np.isfinite(half).all():
            raise ValueError("an embedding is null or does not fit 16-bit floats")
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        if dims is not None and (lengths != dims).any():
            raise ValueError(f"an embedding has not {dims} numbers")
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]).astype(np.int32)), pa.array(half.astype(np.float32)))

    return df.withColumn(vector, rounded(F.col(vector).cast("array<float>")))


def write_embeddings(df: DataFrame, path: str, vector: str = "embedding", dims: int | None = None) -> None:
    """``vectors`` (row_idx, embedding) as Parquet, and ``index`` (CSV), below ``path``."""
    half_precision(df.select("row_idx", vector), vector, dims).write.parquet(f"{path}/vectors")
    write_csv(index_rows(df), f"{path}/index")


def probe_document(coefficients: list[float], intercept: float, moments: DataFrame, c: float, threshold: float) -> str:
    """A probe as JSON: standardization, weights, penalty and threshold.  Moments have a row per dimension."""
    stats = moments.orderBy("dim").collect()  # as long as a vector
    return json.dumps({"mean": [r["mean"] for r in stats], "std": [r["std"] for r in stats], "coefficients": list(coefficients), "intercept": intercept, "c": c, "threshold": threshold}, sort_keys=True)


def write_document(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, checks=None, meta: dict | None = None) -> str:
    """Writes all tables to a version of their own below ``path``, checks them, and names it in ``path/current``.

    ``current`` is replaced by one rename that overwrites, so ``published`` finds the old
    version or the new one at any time, and never a mix.  Of ``meta``, and of each table's
    number of rows, the version has a document.  If a check fails the version stays unnamed.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    written = {name: spark.read.parquet(f"{path}/versions/{version}/{name}") for name in tables}
    if checks is not None:
        failed = [(r["check"], r["violations"]) for r in checks(written).where("violations > 0").collect()]  # a row per rule
        if failed:
            raise ValueError(f"checks failed, nothing published: {failed}")
    rows = {name: df.count() for name, df in written.items()}
    write_document(spark, json.dumps({**(meta or {}), "version": version, "rows": rows}, sort_keys=True), f"{path}/versions/{version}/meta")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place(path).toUri(), conf)
    fs = place(path).getFileSystem(conf)
    staged = place(f"{path}/current-{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, place(f"{path}/current"), over)
    return published(spark, path)


def published(spark: SparkSession, path: str) -> str:
    """The folder of the version that is current."""
    return f"{path}/versions/{spark.read.text(f'{path}/current').first()['value']}"
