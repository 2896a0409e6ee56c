"""Prefix scans that no single task has to run.

A window over a whole chromosome, or over all distinct scores, sorts one key in one task.
Here rows are dealt by (keys, bucket), buckets being ordered like the rows; each bucket is
scanned on its own, and what the buckets before it hold is carried in from a table with one
row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _carried(df: DataFrame, keys: list[str], bucket: str, aggregates: dict, combine) -> DataFrame:
    """One row per (keys, bucket): the aggregates of all buckets before it."""
    sums = df.groupBy(*keys, bucket).agg(*(a.alias(n) for n, a in aggregates.items()))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, *(combine(n).over(before).alias(n) for n in aggregates))


def _with(df: DataFrame, carried: DataFrame, on: list[str]) -> DataFrame:
    return df.join(carried, on, "left")


def running_sums(df: DataFrame, keys: list[str], bucket: str, order: list, columns: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds ``columns`` (new name -> summed column): sums of this and all rows before it, in order of bucket and ``order``.

    Rows that are equal in ``order`` must have been merged before.
    """
    b = "__b"
    df = df.withColumn(b, -F.col(bucket) if descending else F.col(bucket))
    carried = _carried(df, keys, b, {f"__c_{n}": F.sum(c) for n, c in columns.items()}, F.sum)
    within = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(df, carried, [*keys, b])
    return out.withColumns({n: F.sum(c).over(within) + F.coalesce(f"__c_{n}", F.lit(0)) for n, c in columns.items()}).drop(b, *(f"__c_{n}" for n in columns))


def ends_before(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Adds ``before``: the largest end of a key's rows before this one, in order of start and end; null for the first."""
    df = df.withColumn("__b", F.floor(F.col(start) / width))
    on = [*keys, "__b"]
    out = _with(df, _carried(df, keys, "__b", {"__top": F.max(end)}, F.max), on)
    within = Window.partitionBy(*on).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("before", F.greatest(F.max(end).over(within), "__top")).drop("__b", "__top")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int, width: int) -> DataFrame:
    """Adds ``island``: rows of a key whose start is at most ``gap`` past the largest end before it share one."""
    df = df.withColumn("__b", F.floor(F.col(start) / width))
    on = [*keys, "__b"]
    out = _with(df, _carried(df, keys, "__b", {"__top": F.max(end)}, F.max), on)
    order = [start, end]
    within = Window.partitionBy(*on).orderBy(*order)
    before = F.greatest(F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1)), "__top")
    out = out.withColumn("__new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    out = _with(out, _carried(out, keys, "__b", {"__islands": F.sum("__new")}, F.sum), on)
    number = F.sum("__new").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__islands", F.lit(0))
    return out.withColumn("island", number).drop("__b", "__top", "__new", "__islands")
