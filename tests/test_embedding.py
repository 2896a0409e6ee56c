"""Batches of a model: every row once, little padding, one model a worker, and bad numbers are errors."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import embedding


def models():
    """Models with a state, made here so that they travel to the workers whole: their worker, how often one was made, and the largest batch so far."""
    made = []

    class Counting:
        dims = 3

        def __init__(self):
            made.append(1)
            self.most = 0

        def embed(self, seqs):
            self.most = max(self.most, len(seqs) * max(map(len, seqs)))
            return np.array([[os.getpid() % 60_000, len(made), self.most]] * len(seqs), np.float32)

    class Broken(Counting):
        def embed(self, seqs):
            out = super().embed(seqs)
            out[[s.startswith("N") for s in seqs], 1] = np.inf
            return out

    return Counting, Broken


def rows(spark, n=500, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "".join(rng.choice("ACGTN") for _ in range(rng.randrange(300)))) for i in range(n)] + [(n, None), (n + 1, "A" * 5000)], "row_idx long, seq string").repartition(3)


def test_batches_by_hand():
    assert embedding.batches([1, 2, 3, 9, 50, 50], 20, 3) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert embedding.batches([0, 0, 0], 0, 2) == [(0, 2), (2, 3)] and embedding.batches([], 5, 5) == []


def test_rows_come_back_once_with_little_padding(spark):
    df = rows(spark)
    out = embedding.embed(df, budget=4096)
    have = {r["row_idx"]: r["embedding"] for r in out.collect()}
    want = {r["row_idx"]: r["seq"] or "" for r in df.collect()}
    model = embedding.Shares()
    assert len(have) == 502 and all(np.array_equal(np.array(have[i], np.float32), model.embed([s])[0]) for i, s in want.items())
    figures = embedding.padding(out).first()
    assert figures["rows"] == 502 and figures["letters"] == sum(map(len, want.values())) and 0 <= figures["share"] < 0.1
    assert embedding.padding(embedding.embed(df.limit(0))).first()["share"] == 0


def test_a_worker_keeps_its_model(spark):
    embedding.register("counting", models()[0])
    out = embedding.embed(rows(spark), "counting", budget=2000, most=10).select(*(F.col("embedding")[i].alias(c) for i, c in enumerate(("pid", "made", "most"))), "n").collect()
    assert {r["made"] for r in out} == {1.0} and max(r["most"] for r in out if r["n"] < 5000) <= 2000
    assert len(out) == 502


def test_numbers_that_are_not_finite_are_errors(spark):
    embedding.register("broken", models()[1])
    with pytest.raises(Exception, match="finite for row"):
        embedding.embed(rows(spark), "broken").collect()
