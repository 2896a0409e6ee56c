"""A corpus pipeline of five stages; each works on all that the one before it kept.

Stages take (spark, docs, sf_dir).  All but the last return the columns of ``documents``;
the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import quality
from strandline.llm.contamination import find_contained
from strandline.llm.jaccard import jaccard_components
from strandline.llm.lines import dedup_lines
from strandline.llm.packing import pack
from strandline.llm.queries import QUALITY
from strandline.llm.shared import fresh, shared_dir, table
from strandline.llm.tokens import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score reaches the threshold.

    A null text is scored like an empty one; a score at the threshold stays.  Each row is
    judged by its own text, so repeated rows and rows without an id stay or go alike.
    Without labels all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= QUALITY)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that other documents keep; n_chars follows.

    No row goes.  A null text stays null, and so does its n_chars; of equal lines that of
    the largest id stays; repeated rows are one document.  Columns beside those of
    documents stay as they are, whatever their names.
    """
    own = {c: fresh(docs, c) for c in docs.columns if c in ("n_lines", "n_dropped")}
    out = dedup_lines(docs.withColumnsRenamed(own)).drop("n_lines", "n_dropped").withColumnsRenamed({new: c for c, new in own.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a number for each (doc_id, text), which tells rows of the same or a null id apart, and that column's name."""
    key = fresh(docs, "row_key")
    return docs.withColumn(key, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())), key


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group, of ids that repeat or are null one row too; equal rows are one.

    A text without words, a null one too, is a group of its own.  Of one id with several
    texts in a group the row whose number (``_keyed``) is smaller stays; null ids come last.
    """
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
    if not unclear:
        found = jaccard_components(docs)
        return docs.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    keyed, key = _keyed(docs)
    found = jaccard_components(keyed, id_col=key).select(F.col("doc_id").alias(key), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key))
    stay = keyed.select(key, "doc_id").distinct().join(found, key).groupBy("component_id").agg(first.alias("first")).select(f"first.{key}")
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any test item; each row is judged by its own text, and a null one holds none."""
    keyed, key = _keyed(docs)
    found = find_contained(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048; a null text is its end id alone, and each row is packed."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), "byte")


STAGES = [
    ("quality_rff", keep_good),
    ("line_bitmaps", drop_lines),
    ("partenum_jaccard", keep_one_of_near),
    ("minhash_containment", drop_contaminated),
    ("cost_balanced_packing", pack_sequences),
]

#: A fitted model and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
