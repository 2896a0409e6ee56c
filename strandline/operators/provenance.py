"""Content hashes, manifests, reuse, and differences of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import package_name
from strandline.sources.ranges import digests, listed


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of whole files, which tasks stream in bounded parts, so that a file may have any length.

    The path is a file, a folder or a pattern of them; empty files count too.
    """
    found = spark.createDataFrame([(x,) for x in listed(spark, path)], "path string")
    return digests(found).select("path", "sha256", F.col("bytes").alias("size"))


def combined_hash(train: Column, dev: Column, test: Column) -> Column:
    return F.sha2(F.concat(F.lit("train:"), train, F.lit("\ndev:"), dev, F.lit("\ntest:"), test).cast("binary"), 256)


def verified(manifest: DataFrame, found: DataFrame, key: str = "dataset") -> DataFrame:
    """All problems of a manifest (key, sha256) against what was found: missing, unexpected or changed; no rows if it holds."""
    m, f = manifest.select(key, F.col("sha256").alias("want")), found.select(key, F.col("sha256").alias("have"))
    out = m.join(f, key, "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return out.withColumn("problem", problem).where("problem IS NOT NULL").select(key, "problem")


def problems(manifest: DataFrame, found: DataFrame, rows: DataFrame, labels: tuple[int, ...] = (0, 1), key: str = "dataset") -> DataFrame:
    """(dataset, problem): all that keeps a training run from starting: the manifest's, and labels outside of those allowed."""
    allowed = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    wrong = rows.where(~allowed).select(key, F.lit("label").alias("problem")).distinct()
    return verified(manifest, found, key).unionByName(wrong)


def unchanged(wanted: dict, found: dict | None, hashes: DataFrame, key: str = "dataset") -> bool:
    """Whether an earlier run made the same: equal settings, and its manifest ({key: sha256} below "sha256") holds."""
    if found is None or found.get("settings") != wanted:
        return False
    rows = [(str(k), str(v)) for k, v in (found.get("sha256") or {}).items()]
    manifest = hashes.sparkSession.createDataFrame(rows, f"{key} string, sha256 string")
    return bool(rows) and verified(manifest, hashes, key).isEmpty()


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Splits whose keys and hashes no earlier run has."""
    return wanted.join(done, keys, "left_anti")


def package_diff(before: DataFrame, after: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """(name, before, after, change): + added, - removed, ~ changed; names are normalized."""
    a = before.select(package_name(F.col(name)).alias("name"), F.col(version).alias("before"))
    b = after.select(package_name(F.col(name)).alias("name"), F.col(version).alias("after"))
    change = F.when(F.col("before").isNull(), "+").when(F.col("after").isNull(), "-").when(F.col("before") != F.col("after"), "~")
    return a.join(b, "name", "full_outer").withColumn("change", change).where("change IS NOT NULL")
