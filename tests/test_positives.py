"""Windows over elements: covered bases and descriptions come of one join, and windows are written once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandline.operators import extraction, intervals


def rows(n, seed):
    rng = random.Random(seed)
    out = [(rng.choice("ab"), s := rng.randrange(0, 200_000), s + rng.choice([0, 1, 40, 700, 5000, 90_000]), rng.choice(["x", "y", None]), rng.choice("+-")) for _ in range(n)]
    return out + out[:20]


def test_covered_and_described_are_those_of_the_separate_joins(spark):
    regions = spark.createDataFrame(rows(150, 1), "chrom string, start long, end long, subfamily string, region string").repartition(3)
    windows = spark.range(0, 210_000, 512).selectExpr("explode(array('a', 'b', 'c')) AS chrom", "id AS start", "id + 1024 AS end")
    key = ["chrom", "start", "end"]
    whole = intervals.coverage(windows, intervals.merged(regions)).join(extraction.described(windows, regions), key, "left")
    found = windows.join(extraction.covered_and_described(windows, regions), key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    columns = [*key, "covered", "detail", "principal"]
    expected = sorted(map(tuple, whole.select(*columns).collect()), key=str)
    assert len(expected) == 3 * 411
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == expected


def test_windows_of_positives_are_written_once(spark, monkeypatch):
    written, write = [], extraction._written
    monkeypatch.setattr(extraction, "_written", lambda df: written.append(df.columns) or write(df))
    iv = spark.createDataFrame(rows(60, 2), "chrom string, start long, end long, subfamily string, region string").withColumn("strand", F.lit("+"))
    lengths = spark.createDataFrame([("a", 300_000), ("b", 120_000)], "chrom string, length long")
    chunks = spark.range(0, 300_000, 256).selectExpr("explode(array('a', 'b')) AS name", "id div 256 AS chunk", "repeat('ACGT', 64) AS seq")
    out = extraction.positives(intervals.clusters(iv, 500), iv.drop("strand"), lengths, chunks, 256)
    assert sum("elements" in columns for columns in written) == 1
    assert out.where("covered > 0 AND seq <> ''").count() > 0
