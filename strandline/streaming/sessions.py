"""Gap clustering as a stream: sessions of events, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n_events, total) for batch and stream alike; a session ends ``gap`` after its last event."""
    own = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        own = own.withWatermark("__ts", late)
    out = own.groupBy(key, F.session_window("__ts", gap).alias("s")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events", "total")
