"""What operators leave on disk."""

from __future__ import annotations

from strandline.llm import shared


def test_a_written_table_leaves_no_shuffle_behind(spark):
    """The shuffles of a job that only writes a table are gone when it has ended; the session's setting is as before."""
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = spark.conf.get(shared.CLEANUP, None)
    held = tracker.shuffleStatuses().size()
    out = shared.written(spark.range(1000).selectExpr("id % 7 AS k").repartition(3, "k").groupBy("k").count(), "figures")
    assert tracker.shuffleStatuses().size() <= held
    assert sorted(map(tuple, out.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(shared.CLEANUP, None) == before
