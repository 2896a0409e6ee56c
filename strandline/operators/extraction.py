"""Labelled windows out of annotations and sequences: each function says for every candidate why it stays or goes.

Sequences come as ``chunks`` (name, chunk, seq) of fixed size, or as a function that gives
the asked ones, so that a window reads the few rows that it lies on.  ``reason`` is null for a window that stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import accession, centred_start, coverage_class, discard_reason, gap_starts, gc_count, window_starts
from strandline.operators import intervals
from strandline.operators.scan import ends_before
from strandline.operators.similarity import _written
from strandline.sources import readers


def genomic_id(source: Column | str, chrom: Column, start: Column, end: Column) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.concat(source, F.lit(":"), chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def viral_id(name: Column, offset: Column) -> Column:
    return F.concat(F.lit("retrovirus:"), name, F.lit(":"), offset.cast("string"))


def generated_id(number: Column) -> Column:
    """Padded to seven places; longer numbers are whole."""
    text = number.cast("string")
    return F.concat(F.lit("markov:"), F.when(F.length(text) < 7, F.lpad(text, 7, "0")).otherwise(text))


def chromosome_role(chrom: Column, holdout: list[str], dev: list[str]) -> Column:
    """Test for the holdout chromosomes, whatever else they are named for; then dev; else train."""
    return F.when(chrom.isin(*holdout), "test").when(chrom.isin(*dev), "dev").otherwise("train")


def with_sequence(windows: DataFrame, lengths: DataFrame, chunks: readers.Chunks, size: int, places: DataFrame | None = None) -> DataFrame:
    """Windows (chrom, start, end) with ``seq``, empty where the sequence has ended.

    Windows are read for their ranges and again for their columns: ``places`` is a written
    table that has their ranges too, or else they are written first.  Those that begin past
    their chromosome's end are not fetched.
    """
    if places is None:
        windows = places = _written(windows)
    found = readers.fetch(chunks, _ranges(places, lengths), size).withColumnRenamed("name", "chrom")
    return windows.join(found, ["chrom", "start", "end"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def _ranges(places: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, start, end) of the windows that begin before their chromosome's end."""
    return places.join(lengths, "chrom").where(F.col("start") < F.col("length")).select(F.col("chrom").alias("name"), "start", "end")


def sequence_reason(seq: Column, width: int, prefix: str) -> Column:
    """Cut off by the sequence's end, or with other letters."""
    return F.when(F.length(seq) != width, f"{prefix}_edge").otherwise(F.concat(F.lit(f"{prefix}_"), discard_reason(seq)))


def described(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """(chrom, start, end, detail, principal) of the windows that regions touch.

    ``detail`` lists subfamilies and their regions, sorted; the principal subfamily has most
    bases, of equal ones the smaller name.
    """
    key = ["chrom", "start", "end"]
    hits = intervals.overlaps(windows.select(*key).distinct(), regions.select("chrom", "start", "end", "subfamily", "region"))
    return _listed(hits, key)


def _listed(hits: DataFrame, key: list[str], *more: Column) -> DataFrame:
    regions = F.array_join(F.sort_array(F.collect_set("region_b")), ",").alias("regions")
    own = hits.groupBy(*key, F.col("subfamily_b").alias("subfamily")).agg(F.sum("overlap").alias("bases"), regions, *more)
    detail = F.array_join(F.sort_array(F.collect_list(F.concat("subfamily", F.lit(":"), "regions"))), ";")
    total = [F.sum("covered").alias("covered")] if more else []
    return own.groupBy(*key).agg(detail.alias("detail"), F.min_by("subfamily", F.struct(-F.col("bases"), "subfamily")).alias("principal"), *total)


def covered_and_described(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """(chrom, start, end, detail, principal, covered) of the written windows that regions touch, each window given once.

    Each base that regions cover is counted for the first region over it, so that one join
    gives all three.  Its rows go to their window once: both sums, and a join by the
    window's place, are made where they have come to.
    """
    key = ["chrom", "start", "end"]
    return _listed(_fresh_hits(windows, regions).repartition(*key), key, F.sum("fresh").alias("covered"))


def _fresh_hits(windows: DataFrame, regions: DataFrame) -> DataFrame:
    """(chrom, start, end, subfamily_b, region_b, overlap, fresh) of windows and the regions that touch them; ``fresh`` has the bases that no region before covers."""
    key = ["chrom", "start", "end"]
    own = ends_before(regions.select(*key, "subfamily", "region").where("end > start"), ["chrom"], "start", "end", intervals.BUCKET)
    own = own.withColumn("fresh", F.greatest("start", "before")).drop("before")
    hits = intervals.overlaps(windows.select(*key), _written(own))
    fresh = F.greatest(F.least("end", "end_b") - F.greatest("start", "fresh_b"), F.lit(0))
    return hits.select(*key, "subfamily_b", "region_b", "overlap", fresh.alias("fresh"))


#: The stretch of ``intervals.BUCKET`` bases that a window begins in, and windows whose rows a task sorts.
NEAR, SORTED = "__near", 200_000


def _dealt_near(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows (chrom, start and others) dealt by chromosome and stretch, so that those beside each other travel, and are compressed, together."""
    return rows.withColumn(NEAR, F.floor(F.col("start") / intervals.BUCKET)).repartition(tasks, "chrom", NEAR)


def element_windows(elements: DataFrame, lengths: DataFrame, width: int, stride: int) -> DataFrame:
    """(chrom, start, end, strand, elements): one row per window, with all elements that it was made for.

    Windows are those of ``window_starts``, made by stretches.  Elements of a window are
    ordered by strand and start; the first one's strand is the window's.  Lengths are (chrom, length); an element of an unknown chromosome has no windows.
    """
    a, b, size = F.col("start"), F.col("end"), intervals.BUCKET
    one = centred_start(a, b, width, F.col("length"))
    own = elements.join(lengths.where(F.col("length") >= width), "chrom").withColumns({"first": F.when(b - a >= width, a).otherwise(one), "last": F.when(b - a >= width, b - width).otherwise(one)})
    own = own.select("chrom", "strand", F.col("start").alias("from"), "element", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))).alias(NEAR))
    own = own.repartition("chrom", NEAR)  # an element goes to each stretch that its windows begin in
    first, last, low = F.col("first"), F.col("last"), F.col(NEAR) * size
    lead = first + F.ceil(F.greatest(low - first, F.lit(0)) / stride) * stride
    upto, none = F.least(last, low + size - 1), F.array().cast("array<bigint>")
    tiled = F.when(lead <= upto, F.sequence(lead, upto, F.lit(stride).cast("bigint"))).otherwise(none)
    flush = F.when((last >= low) & (last < low + size) & ((last - first) % stride != 0), F.array(last)).otherwise(none)
    own = own.select("chrom", NEAR, "strand", "from", "element", F.explode(F.concat(tiled, flush)).alias("start"))
    listed = own.groupBy("chrom", NEAR, "start").agg(F.array_sort(F.collect_list(F.struct("strand", "from", "element"))).alias("of"))
    return listed.select("chrom", "start", (F.col("start") + width).alias("end"), F.col("of")[0]["strand"].alias("strand"), F.transform("of", lambda x: F.concat(F.lit("elem:"), x["element"])).alias("elements"))


def positives(elements: DataFrame, regions: DataFrame, lengths: DataFrame, chunks: readers.Chunks, size: int, width: int = 1024, stride: int = 512, least: int = 200) -> DataFrame:
    """Windows over elements, with coverage by the merged regions, sequence, description and ``reason``.

    Less than ``least`` covered bases put a window into the grey zone, none at all outside.
    Windows are written once; they, the regions that touch them and their letters are rows
    of one table, which is dealt once by stretches and grouped there.
    """
    lengths = _written(lengths)
    windows = _written(element_windows(elements, lengths, width, stride))
    known = _gathered(windows, _fresh_hits(windows, regions), readers.parts(chunks, _ranges(windows, lengths), size), width)
    covered = coverage_class(F.col("covered"), least)
    reason = F.when(covered == "none", "l1_uncovered").when(covered == "grey", "l1_grey").otherwise(sequence_reason(F.col("seq"), width, "l1"))
    return known.withColumns({"window_id": genomic_id("l1", F.col("chrom"), F.col("start"), F.col("end")), "gc": gc_count(F.col("seq")), "reason": reason})


def _gathered(windows: DataFrame, hits: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """The windows of ``width``, each given once, with ``covered`` of their fresh hits, ``detail`` and ``principal`` (see ``described``), and ``seq`` of their parts.

    Rows have few columns, of which most are null: they are sorted where they have come to,
    in as many tasks as the written windows ask for, so that a sort fits into memory.
    """
    tasks = max(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), windows.count() // SORTED + 1)
    place = [F.col("chrom"), F.col("start")]
    none = [F.lit(None).cast(windows.schema[c].dataType).alias(c) for c in ("strand", "elements")]
    hit = F.struct(F.col("subfamily_b").alias("subfamily"), F.col("region_b").alias("region"), "overlap", "fresh")
    hits = hits.select(*place, *none, hit.alias("hit"))
    parts = parts.select(F.col("name").alias("chrom"), "start", *none, F.struct("chunk", "part").alias("part"))
    rows = windows.select(*place, "strand", "elements").unionByName(hits, allowMissingColumns=True).unionByName(parts, allowMissingColumns=True)
    own = [F.first(c, ignorenulls=True).alias(c) for c in ("strand", "elements")]
    whole = _dealt_near(rows, tasks).groupBy("chrom", NEAR, "start").agg(*own, F.collect_list("hit").alias("hits"), readers.joined(F.collect_list("part")).alias("seq"))

    def of(name: Column) -> Column:
        mine = F.filter("hits", lambda x: x["subfamily"].eqNullSafe(name))
        regions = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(mine, lambda x: x["region"]), lambda r: r.isNotNull()))), ",")
        bases = F.aggregate(mine, F.lit(0).cast("long"), lambda s, x: s + x["overlap"])
        return F.struct((-bases).alias("bases"), name.alias("subfamily"), F.concat(name, F.lit(":"), regions).alias("text"))

    listed = F.transform(F.array_distinct(F.transform("hits", lambda x: x["subfamily"])), of)
    whole = whole.withColumn("listed", F.when(F.size("hits") > 0, listed))
    texts = F.array_sort(F.filter(F.transform("listed", lambda x: x["text"]), lambda x: x.isNotNull()))
    return whole.select(
        "chrom",
        "start",
        (F.col("start") + width).alias("end"),
        "strand",
        "elements",
        F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["fresh"]).alias("covered"),
        F.array_join(texts, ";").alias("detail"),
        F.array_min("listed")["subfamily"].alias("principal"),
        "seq",
    )


def transposon_candidates(elements: DataFrame, near: DataFrame, excluded: DataFrame, lengths: DataFrame, chunks: readers.Chunks, size: int, width: int = 1024) -> DataFrame:
    """Windows centred on elements (chrom, start, end, strand, name, class, family), one per place, with gc and ``reason``.

    Of elements that give the same window the first one (by all its columns) is kept, and
    ``duplicates`` counts the others.
    """
    order = ["from", "to", "strand", "name", "class", "family"]
    own = elements.join(lengths, "chrom").withColumns({"from": F.col("start"), "to": F.col("end")})
    own = own.withColumn("start", centred_start(F.col("from"), F.col("to"), width, F.col("length"))).select("chrom", "start", *order)
    counted = own.groupBy("chrom", "start").agg((F.count("*") - 1).alias("duplicates"))
    first = intervals.first_of(own, ["chrom", "start"], order).join(counted, ["chrom", "start"]).withColumn("end", F.col("start") + width)
    touched = intervals.untouched(_written(first), [("neg_touches_l1", near), ("te_touches_ltr_sva", excluded)])
    known = with_sequence(touched, lengths, chunks, size)
    return known.withColumns({"gc": gc_count(F.col("seq")), "reason": F.coalesce("reason", sequence_reason(F.col("seq"), width, "te"))}).drop("from", "to")


def blocked(*lists: DataFrame) -> DataFrame:
    """The union of interval lists, merged."""
    return intervals.merged(reduce(DataFrame.unionByName, [x.select("chrom", "start", "end") for x in lists]))


def background_candidates(cover: DataFrame, lengths: DataFrame, chunks: readers.Chunks, size: int, width: int = 1024) -> DataFrame:
    """Windows side by side in what merged intervals leave free, with gc and ``reason``."""
    spans = lengths.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"))
    free = intervals.gaps(cover, spans)
    tiles = free.select("chrom", F.explode(gap_starts(F.col("gap_start"), F.col("gap_end"), width)).alias("start")).withColumn("end", F.col("start") + width)
    known = with_sequence(tiles, lengths, chunks, size)
    return known.withColumns({"gc": gc_count(F.col("seq")), "reason": sequence_reason(F.col("seq"), width, "background")})


def viral_windows(records: DataFrame, width: int = 1024, stride: int = 512) -> DataFrame:
    """Windows over whole records (name, seq), with the accession as their key, and ``reason``.

    A record without room for a window is one row without a place.
    """
    n = F.length("seq").cast("bigint")
    starts = F.when(n >= width, window_starts(F.lit(0).cast("bigint"), n, width, stride, n))
    own = records.select("name", "seq", F.explode_outer(starts).alias("start"))
    own = own.withColumns({"seq": F.substring("seq", (F.col("start") + 1).cast("int"), F.lit(width)), "detail": accession(F.col("name"))})
    reason = F.when(F.col("start").isNull(), "retro_too_short").when(discard_reason(F.col("seq")).isNotNull(), "retro_iupac")
    return own.withColumns({"window_id": viral_id(F.col("name"), F.col("start")), "key": F.concat(F.lit("acc:"), "detail"), "reason": reason})


def product_tally(records: DataFrame) -> DataFrame:
    """(product, n) of the records that ``product_records`` has chosen."""
    return records.groupBy("product").agg(F.count("*").alias("n"))


def tally(windows: DataFrame) -> DataFrame:
    """(reason, n): windows by the reason why they go, ``kept`` for those that stay."""
    return windows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def union_windows(*tables: DataFrame, id_col: str = "window_id") -> DataFrame:
    """All windows; an id that occurs twice is an error, raised before anything is returned."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    twice = out.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{id_col} occurs more than once: {[r[id_col] for r in twice]}")
    return out


def distinct_windows(*tables: DataFrame, id_col: str = "window_id") -> DataFrame:
    """Each id once, as the first of the tables has it; a table's own repeats go by their smallest row."""
    ranked = reduce(lambda a, b: a.unionByName(b), [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)])
    rest = [c for c in ranked.columns if c not in (id_col, "__table")]
    return intervals.first_of(ranked, [id_col], ["__table", *rest]).drop("__table")
