"""Readers of annotation tables, sequences, datasets and reports.

Each parser works on a DataFrame of lines or columns; the reader beside it adds the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.similarity import _written
from strandline.sources.ranges import block_lines

# Columns of the dataset contract, chromosomes, classes of repeats, the pattern of polymerase products.
CONTRACT = ("sequence", "label", "source", "detail", "window_id", "orientation", "chrom", "start", "end", "strand", "group", "gc", "max_id_train", "max_id_train_local")
CHROMOSOMES = tuple(f"chr{x}" for x in (*range(1, 23), "X", "Y"))
SIMPLE = ("Simple_repeat", "Low_complexity")
PRODUCT = r"(?i)\bpol\b|polymerase|reverse transcriptase"
#: Chunks (name, chunk, seq), or what gives those of a table of (name, chunk).
Chunks = DataFrame | Callable[[DataFrame], DataFrame]
ANNOTATION = "chrom string, start long, end long, subfamily string, region string, strand string, mismatches long, deletions long, insertions long, locus_length long, identity double, similarity double"


def annotation_rows(lines: DataFrame, chromosomes: tuple[str, ...] | None = CHROMOSOMES, line: str = "value") -> DataFrame:
    """Typed rows of a table of 12 tab-separated columns; comments and blank lines are passed over.

    A line with another number of columns is an error, wherever it lies; a length that
    doesn't fit is one within the chromosomes.
    """
    fields = F.split(F.col(line), "\t")
    rows = lines.where(~F.col(line).startswith("#") & (F.trim(F.col(line)) != "")).select(
        F.when(F.size(fields) == 12, fields).otherwise(F.raise_error(F.concat(F.lit("12 columns expected: "), F.col(line))).cast("array<string>")).alias("f")
    )
    kinds = [x.split() for x in ANNOTATION.split(", ")]
    out = rows.select(*(F.col("f")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)))
    if chromosomes is not None:
        out = out.where(F.col("chrom").isin(*chromosomes))
    fits = F.when(F.col("end") - F.col("start") == F.col("locus_length"), F.col("end"))
    return out.withColumn("end", fits.otherwise(F.raise_error(F.concat(F.lit("length doesn't fit at "), F.col("chrom"), F.lit(":"), F.col("start").cast("string"))).cast("long")))


def read_annotation(spark: SparkSession, path: str, chromosomes: tuple[str, ...] | None = CHROMOSOMES) -> DataFrame:
    return annotation_rows(spark.read.text(path), chromosomes)


def repeat_flags(df: DataFrame, te_classes: tuple[str, ...]) -> DataFrame:
    """Adds is_l1, is_ltr_sva, is_te (the first that holds) and is_interspersed (on its own)."""
    l1 = F.col("family").startswith("L1")
    ltr = (F.regexp_replace("class", r"\?+$", "") == "LTR") | (F.col("family") == "SVA") | (F.col("class") == "Retroposon")
    return df.withColumns({"is_l1": l1, "is_ltr_sva": ~l1 & ltr, "is_te": ~l1 & ~ltr & F.col("class").isin(*te_classes), "is_interspersed": ~F.col("class").isin(*SIMPLE)})


def read_repeats(spark: SparkSession, path: str, te_classes: tuple[str, ...], chromosomes: tuple[str, ...] = CHROMOSOMES, blocks: bool = False) -> DataFrame:
    """A tab-separated repeat table; ``blocks`` says that it is a file of gzip blocks, which many tasks read.

    Any other gzip file is one task, so convert it once, to blocks or to Parquet.
    """
    f = F.split("value", "\t", 14)
    df = (block_lines(spark, path) if blocks else spark.read.text(path)).select(f[5].alias("chrom"), f[6].cast("long").alias("start"), f[7].cast("long").alias("end"), f[9].alias("strand"), f[10].alias("name"), f[11].alias("class"), f[12].alias("family"))
    return repeat_flags(df.where(F.col("chrom").isin(*chromosomes)), te_classes)


def fasta_records(chunks: DataFrame, value: str = "value") -> DataFrame:
    """(name, comment, seq) of text that is split at ``>``."""
    head, body = F.substring_index(F.col(value), "\n", 1), F.regexp_replace(F.col(value), r"^[^\n]*\n?", "")
    own = chunks.where(F.trim(F.col(value)) != "")
    return own.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records may be long: a record is a row, whole."""
    return fasta_records(spark.read.option("lineSep", ">").text(path))


def chunked(records: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(name, chunk, seq): fixed pieces, so that a range is fetched from few rows and no row is a chromosome."""
    at = records.select("name", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / size))).alias("chunk"))
    return at.select("name", "chunk", F.substring("seq", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def fetch(chunks: Chunks, ranges: DataFrame, size: int = 1 << 16) -> DataFrame:
    """The ranges (name, start, end; 0-based half-open) with ``seq``; short where the record ends."""
    return parts(chunks, ranges, size).groupBy("name", "start", "end").agg(joined(F.collect_list(F.struct("chunk", "part"))).alias("seq"))


def joined(found: Column) -> Column:
    """The letters of a list of (chunk, part)."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: x["part"]), "")


def parts(chunks: Chunks, ranges: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(name, start, end, chunk, part): a row for each chunk that a range lies on, with the letters of it.

    ``chunks`` may be a function that gives the chunks of a table of (name, chunk), each once.

    The wanted (name, chunk) are written, so that Spark knows their size: if they are few it
    sends them to the scan of the chunks, and letters of other chunks aren't even made;
    if not, both sides are shuffled.
    """
    want = ranges.select("name", "start", "end").distinct().withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.greatest("end", F.col("start") + 1) - 1) / size))))
    want = _written(want)
    if callable(chunks):
        chunks = chunks(want.select("name", "chunk").distinct())
    else:
        needed = want.select(F.col("name").alias("__name"), F.col("chunk").alias("__chunk")).distinct()
        chunks = chunks.join(needed, (F.col("name") == F.col("__name")) & (F.col("chunk") == F.col("__chunk")), "left_semi")
    lo, hi = F.greatest(F.col("start") - F.col("chunk") * size, F.lit(0)), F.least(F.col("end") - F.col("chunk") * size, F.lit(size))
    part = F.substring("seq", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    return want.join(chunks, ["name", "chunk"]).select("name", "start", "end", "chunk", part.alias("part"))


def product_records(records: DataFrame) -> DataFrame:
    """Records whose product (the second field of the comment between bars, or all of it) names a polymerase."""
    parts = F.split("comment", r"\|")
    product = F.when(F.size(parts) > 1, parts[1]).otherwise(F.col("comment"))
    return records.withColumn("product", F.trim(F.substring_index(product, "[", 1))).where(product.rlike(PRODUCT))


def read_dataset(spark: SparkSession, path: str, with_sequence: bool = True) -> DataFrame:
    """A dataset of the 14-column contract with ``row_idx``; labels other than 0 and 1 are an error, empty figures null."""
    raw = spark.read.option("header", True).csv(path)
    lacking = [c for c in CONTRACT if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks {lacking}")
    return checked_dataset(raw, with_sequence)


def checked_dataset(raw: DataFrame, with_sequence: bool = True) -> DataFrame:
    label = F.when(F.col("label").isin("0", "1"), F.col("label").cast("int")).otherwise(F.raise_error(F.concat(F.lit("label: "), F.coalesce("label", F.lit("null")))).cast("int"))
    figure = lambda c: F.nullif(F.col(c), F.lit("")).cast("double").alias(c)
    seq = [F.upper(F.trim("sequence")).alias("sequence")] if with_sequence else []
    return raw.select(*seq, label.alias("label"), "source", "window_id", "orientation", figure("max_id_train"), figure("max_id_train_local"))


def labelled_rows(raw: DataFrame) -> DataFrame:
    """(sequence, label) of a table of strings: any whole number is a label, other columns are passed over."""
    whole = F.trim("label").rlike(r"^[+-]?\d+$")
    label = F.when(whole, F.trim("label").cast("long")).otherwise(F.raise_error(F.concat(F.lit("label: "), F.coalesce("label", F.lit("null")))).cast("long"))
    return raw.select("sequence", label.alias("label"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    lacking = [c for c in ("sequence", "label") if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks {lacking}")
    return labelled_rows(raw)


def aligned_embeddings(vectors: DataFrame, index: DataFrame, rows: DataFrame, dims: int | None = None) -> DataFrame:
    """The dataset's rows with their embeddings, by the row's number.

    A number that one of the three lacks, another window, orientation or label in the index,
    or a vector of another length is an error: the embeddings are of another file.
    """
    key = lambda df, side: df.select("row_idx", F.struct(F.col("window_id").cast("string"), F.col("orientation").cast("string"), F.col("label").cast("string")).alias(side))
    both = rows.join(key(index, "__index").join(vectors, "row_idx", "full_outer"), "row_idx", "full_outer")
    own = F.struct(F.col("window_id").cast("string"), F.col("orientation").cast("string"), F.col("label").cast("string"))
    right = F.col("__index").eqNullSafe(own) & F.col("embedding").isNotNull()
    if dims is not None:
        right &= F.size("embedding") == dims
    bad = F.raise_error(F.concat(F.lit("embeddings don't fit the rows, first at "), F.col("row_idx").cast("string")))
    return both.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(bad.cast(vectors.schema["embedding"].dataType))).drop("__index")


def read_embeddings(spark: SparkSession, path: str, rows: DataFrame, dims: int | None = None) -> DataFrame:
    index = spark.read.option("header", True).csv(f"{path}/index").withColumn("row_idx", F.col("row_idx").cast("long"))
    return aligned_embeddings(spark.read.parquet(f"{path}/vectors"), index, rows, dims)


def read_benchmark(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    """A Parquet benchmark (sequence string, label integer); nulls and another task are errors."""
    df = spark.read.parquet(path)
    if not isinstance(df.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or not isinstance(df.schema["sequence"].dataType, T.StringType):
        raise ValueError("sequence must be string and label an integer")
    bad = F.col("sequence").isNull() | F.col("label").isNull()
    if task is not None and "task" in df.columns:
        bad |= ~F.col("task").eqNullSafe(F.lit(task))
    if df.where(bad).limit(1).count():
        raise ValueError("null sequence or label, or a row of another task")
    return df


def pair_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """(rep, member) numbers of a two-column table of names like s12_f; the orientation goes."""
    f = F.split(F.col(line), "\t")
    number = lambda x: F.regexp_extract(x, r"^s(\d+)_[fr]$", 1).cast("long")
    return lines.select(number(f[0]).alias("rep"), number(f[1]).alias("member"))


def hit_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    f = F.split(F.col(line), "\t")
    names = (("query", "string"), ("target", "string"), ("fident", "double"), ("alnlen", "long"), ("qcov", "double"), ("tcov", "double"))
    return lines.select(*(f[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def read_metadata(spark: SparkSession, path: str) -> dict | None:
    """A JSON file, or None if it isn't there or isn't JSON."""
    import json

    try:
        rows = spark.read.option("wholetext", True).text(path).collect()  # one file
        return json.loads(rows[0]["value"])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, (ValueError, IndexError)):
            return None
        raise
