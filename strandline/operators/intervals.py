"""Interval algebra on 0-based half-open (chrom, start, end) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.scan import islands
from strandline.operators.similarity import _written

#: Width of the buckets that scans deal positions by.
BUCKET = 1 << 16
#: Range joins: width of the narrowest bins, how much wider those of the next level are, and levels (the top one's bins hold 2^28).
BIN = 1 << 12
SPREAD = 16
LEVELS = 5


def merged(iv: DataFrame, keys: tuple[str, ...] = ("chrom",), bucket: int = BUCKET) -> DataFrame:
    """Union: overlapping and touching intervals are one; empty ones are dropped."""
    own = iv.where("end > start").select(*keys, "start", "end")
    return islands(own, list(keys), "start", "end", 0, bucket).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def clusters(iv: DataFrame, max_gap: int = 500, keys: tuple[str, ...] = ("chrom", "strand"), bucket: int = BUCKET, members: tuple[str, ...] = ()) -> DataFrame:
    """Elements: rows of a strand at most ``max_gap`` apart; with a sorted array of their members' columns if asked for."""
    own = islands(iv, list(keys), "start", "end", max_gap, bucket)
    more = [F.sort_array(F.collect_list(F.struct(*members))).alias("members")] if members else []
    out = own.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_members"), *more).drop("island")
    return out.withColumn("element", F.concat(*(x for k in keys for x in (F.col(k), F.lit(":"))), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def _level(start: str, end: str, bucket: int) -> Column:
    """The lowest level on which the interval touches ``SPREAD + 1`` bins at most; of longer ones the top."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(F.col(end) - F.col(start) <= bucket * SPREAD ** (k + 1), k).otherwise(out)
    return out


def _levels(df: DataFrame, start: str, end: str, bucket: int) -> Column:
    """The levels that a table's intervals have, as the bits of one number; it is a subquery, run before the join."""
    bit = F.element_at(F.array(*(F.lit(1 << k) for k in range(LEVELS))), _level(start, end, bucket) + 1)
    return F.coalesce(df.where(F.col(end) > F.col(start)).agg(F.bit_or(bit)).scalar(), F.lit(0))


def _dealt(df: DataFrame, start: str, end: str, bucket: int, held: Column, side: int) -> DataFrame:
    """A row for each ``__bin`` of an interval: on its own level, and on each level of the other table (``held``) above it.

    Bins in which the left side (0) is on its own level are even, those of the right side
    odd.  A right interval is dealt to even bins of its own level too, which is where two of
    one level meet; so each pair meets on the level of its longer interval, on one kind of bin.
    """
    none = F.array().cast("array<bigint>")

    def bins(k: int, kind: int) -> Column:
        width = bucket * SPREAD**k
        first, last = (F.floor(at / width) * (2 * LEVELS) + (2 * k + kind) for at in (F.col(start), F.col(end) - 1))
        return F.sequence(first, last, F.lit(2 * LEVELS).cast("bigint"))

    level, dealt = F.col("__level"), []
    for k in range(LEVELS):
        other = F.col("__held").bitwiseAND(1 << k) > 0
        lower = F.col("__held").bitwiseAND((1 << k) - 1) > 0
        if side == 0:
            dealt += [F.when(level == k, bins(k, 0)), F.when((level < k) & other, bins(k, 1))]
        else:
            dealt += [F.when((level <= k) & other, bins(k, 0)), F.when((level == k) & lower, bins(k, 1))]
    own = df.where(F.col(end) > F.col(start)).withColumns({"__level": _level(start, end, bucket), "__held": held})
    return own.withColumn("__bin", F.explode(F.concat(*(F.coalesce(x, none) for x in dealt)))).drop("__level", "__held")


def overlaps(a: DataFrame, b: DataFrame, bucket: int = BIN, drawn: DataFrame | None = None) -> DataFrame:
    """Pairs of overlapping rows: a's columns, and b's with the suffix ``_b`` (chrom is shared), and ``overlap``.

    Bins have levels, each ``SPREAD`` times as wide as the one below, and an interval's level
    follows its length: rows dealt grow with the intervals and not with their lengths, and
    two intervals that meet in a bin aren't much shorter than it, or one of them is long.
    A pair is kept in the bin that its overlap begins in, so that none comes out twice.
    ``drawn`` is a table with a's lengths that costs less to read than a itself.
    """
    right = b.select(*(F.col(c).alias(c if c == "chrom" else f"{c}_b") for c in b.columns))
    left = _dealt(a, "start", "end", bucket, _levels(right, "start_b", "end_b", bucket), 0)
    right = _dealt(right, "start_b", "end_b", bucket, _levels(a if drawn is None else drawn, "start", "end", bucket), 1)
    pairs = left.join(right, ["chrom", "__bin"]).where((F.col("start_b") < F.col("end")) & (F.col("end_b") > F.col("start")))
    width = F.element_at(F.array(*(F.lit(bucket * SPREAD**k) for k in range(LEVELS))), (F.pmod("__bin", F.lit(2 * LEVELS)) / 2).cast("int") + 1)
    pairs = pairs.where(F.floor(F.col("__bin") / (2 * LEVELS)) == F.floor(F.greatest("start", "start_b") / width)).drop("__bin")
    return pairs.withColumn("overlap", F.least("end", "end_b") - F.greatest("start", "start_b"))


def coverage(windows: DataFrame, cover: DataFrame, key: list[str] | None = None, bucket: int = BIN) -> DataFrame:
    """Windows with ``covered``: bases that the merged intervals ``cover`` share with them, 0 if none."""
    key = key or ["chrom", "start", "end"]
    hits = overlaps(windows.select(*key).distinct(), _written(cover.select("chrom", "start", "end")), bucket, windows)
    return windows.join(hits.groupBy(*key).agg(F.sum("overlap").alias("covered")), key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def untouched(windows: DataFrame, blocked: list[tuple[str, DataFrame]], bucket: int = BIN) -> DataFrame:
    """Windows with ``reason``: the first of the named interval tables that touches them, null if none does.

    All tables are merged and joined in one pass; the first name is a minimum that is combined before the shuffle.
    """
    key = ["chrom", "start", "end"]
    lists = [x.select(*key).withColumn("__list", F.lit(i)) for i, (_, x) in enumerate(blocked)]
    cover = _written(merged(reduce(DataFrame.unionByName, lists), ("chrom", "__list")))
    hits = overlaps(windows.select(*key).distinct(), cover, bucket, windows).groupBy(*key).agg(F.min("__list_b").alias("__first"))
    reason = F.coalesce(*(F.when(F.col("__first") == i, name) for i, (name, _) in enumerate(blocked)))
    return windows.join(hits, key, "left").withColumn("reason", reason).drop("__first")


def gaps(cover: DataFrame, spans: DataFrame, bucket: int = BUCKET, bins: int = BIN) -> DataFrame:
    """What merged intervals leave free of the spans (chrom, start, end), the ends included.

    A gap begins at a span's start or at the end of an interval in it, and ends at the next
    interval's start or the span's end: the free pieces are the complement's islands.
    """
    hit = overlaps(spans.select("chrom", "start", "end"), _written(cover.select("chrom", "start", "end")), bins)
    key = ["chrom", "start", "end"]
    inner = hit.select(*key, F.greatest("start", "start_b").alias("s"), F.least("end", "end_b").alias("e"))
    edges = inner.select(*key, F.col("e").alias("at"), F.lit(1).alias("opens")).union(inner.select(*key, F.col("s"), F.lit(0)))
    edges = edges.union(spans.select(*key, F.col("start"), F.lit(1))).union(spans.select(*key, F.col("end"), F.lit(0)))
    edges = _written(edges.groupBy(*key, "opens", "at").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("at") / bucket)))
    from strandline.operators.scan import running_sums

    # the n-th opening edge and the n-th closing edge of a span belong together
    ranked = running_sums(edges, [*key, "opens"], "b", ["at"], {"upto": "n"})
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))))
    opens = ranked.where("opens = 1").select(*key, "rank", F.col("at").alias("gap_start"))
    closes = ranked.where("opens = 0").select(*key, "rank", F.col("at").alias("gap_end"))
    return opens.join(closes, [*key, "rank"]).where("gap_end > gap_start").drop("rank")


def first_of(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key, by an aggregation that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    named = F.struct(*(F.col(o).alias(f"__o{i}") if isinstance(o, str) else o.alias(f"__o{i}") for i, o in enumerate(order)), F.struct(*rest).alias("__row"))
    return df.groupBy(*key).agg(F.min(named).alias("__first")).select(*key, *(F.col(f"__first.__row.{c}").alias(c) for c in rest))
