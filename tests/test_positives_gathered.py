"""Positives: rows of a window meet once, dealt by stretches; windows by stretches are those of ``window_starts``."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.sequence import window_starts
from strandline.operators import extraction, intervals


def table(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), s := rng.randrange(0, 250_000), s + rng.choice([0, 1, 40, 700, 5000, 90_000]), rng.choice(["x", "y", None]), rng.choice(["+", "-", None]), rng.choice("+-")) for _ in range(n)]
    return spark.createDataFrame(rows + rows[:20], "chrom string, start long, end long, subfamily string, region string, strand string").repartition(3)


@pytest.mark.parametrize("stride", [512, 300])
def test_windows_by_stretches(spark, monkeypatch, stride):
    monkeypatch.setattr(intervals, "BUCKET", 1 << 12)
    elements = intervals.clusters(table(spark, 120, 3), 500, bucket=1 << 16)
    lengths = spark.createDataFrame([("a", 300_000), ("b", 900)], "chrom string, length long")
    for lengths, least in ((lengths, 500), (lengths.withColumn("length", F.lit(300_000).cast("long")), 900)):
        starts = F.explode(window_starts(F.col("start"), F.col("end"), 1024, stride, F.col("length")))
        want = sorted(map(tuple, elements.join(lengths, "chrom").select("chrom", starts.alias("s"), "strand", "element").collect()))
        found = extraction.element_windows(elements, lengths, 1024, stride).collect()
        assert len({(r["chrom"], r["start"]) for r in found}) == len(found)
        assert sorted((r["chrom"], r["start"], e.split(":")[2], e[5:]) for r in found for e in r["elements"]) == want and len(want) > least / 5


def test_positives_are_those_of_the_separate_joins(spark):
    iv = table(spark, 80, 5)
    lengths = spark.createDataFrame([("a", 300_000), ("b", 120_000)], "chrom string, length long")
    chunks = spark.range(0, 300_000, 256).selectExpr("explode(array('a', 'b')) AS name", "id div 256 AS chunk", "concat(repeat('ACGT', 32), repeat(substr('ACGTN', 1 + CAST(id % 5 AS INT), 1), 128)) AS seq")
    elements, key = intervals.clusters(iv, 500), ["chrom", "start", "end"]
    regions = iv.drop("strand").where("start % 3 > 0")
    windows = extraction._written(extraction.element_windows(elements, lengths, 1024, 512))
    want = windows.join(extraction.covered_and_described(windows, regions), key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    want = extraction.with_sequence(want, lengths, chunks, 256, windows)
    found = extraction.positives(elements, regions, lengths, chunks, 256)
    columns = [*key, "strand", "elements", "covered", "detail", "principal", "seq"]
    rows = lambda x: sorted(map(tuple, x.select(*columns).collect()), key=str)
    assert rows(found) == rows(want) and found.count() > 200
    assert found.where("covered = 0 AND detail IS NULL").count() and found.where("detail = ''").count() + found.where("principal IS NULL").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join LeftOuter" not in plan
