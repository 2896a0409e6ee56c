"""Views on the driver's tables that stand for annotations, windows, sequences, edges and predictions.

Each has a DataFrame and, for the oracles, the SQL of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import hash_fraction
from strandline.operators.containment import contained_items


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation rows with an identity of 0.95 or more."""
    x = table(spark, sf_dir, "lineitem").where("l_discount <= 0.05")
    return x.selectExpr("concat('s', l_suppkey) AS chrom", "CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand", "l_partkey * 400 AS start", "l_partkey * 400 + CAST(l_quantity AS BIGINT) * 20 AS end", "l_returnflag AS cls").distinct()


IV = """iv AS (SELECT DISTINCT 's' || l_suppkey AS chrom, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
  l_partkey * 400 AS "start", l_partkey * 400 + CAST(l_quantity AS BIGINT) * 20 AS "end", l_returnflag AS cls FROM lineitem WHERE l_discount <= 0.05)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1024 at other rows' places."""
    x = table(spark, sf_dir, "lineitem").where("l_discount > 0.05")
    return x.selectExpr("concat('s', l_suppkey) AS chrom", "l_partkey * 400 + 100 AS start", "l_partkey * 400 + 1124 AS end").distinct()


PROBES = """probes AS (SELECT DISTINCT 's' || l_suppkey AS chrom, l_partkey * 400 + 100 AS "start", l_partkey * 400 + 1124 AS "end" FROM lineitem WHERE l_discount > 0.05)"""


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of 1024 for each document; every tenth is a copy of another with one letter changed."""
    base = "doc_id - CAST(doc_id % 10 = 1 AS INT)"
    blocks = ", ".join(f"translate(sha2(concat({base}, ':', {i}), 256), '0123456789abcdef', 'ACGTACGTACGTACGT')" for i in range(16))
    x = table(spark, sf_dir, "documents").selectExpr("doc_id", "source", f"concat({blocks}) AS seq")
    return x.selectExpr("doc_id", "source", "CASE WHEN doc_id % 10 = 1 THEN concat(substr(seq, 1, 99), 'A', substr(seq, 101)) ELSE seq END AS seq")


DNA = (
    "dna AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 1 THEN substr(seq, 1, 99) || 'A' || substr(seq, 101) ELSE seq END AS seq FROM (SELECT doc_id, source, "
    + " || ".join(f"translate(sha256((doc_id - CAST(doc_id % 10 = 1 AS INT)) || ':' || {i}), '0123456789abcdef', 'ACGTACGTACGTACGT')" for i in range(16))
    + " AS seq FROM documents))"
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orientations of each labelled document with a probability; identities are missing for some."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    x = x.withColumn("orientation", F.explode(F.array(F.lit("fwd"), F.lit("rc"))))
    row = F.col("doc_id") * 2 + (F.col("orientation") == "rc").cast("int")
    return x.select(
        row.alias("row_idx"),
        F.col("doc_id").alias("window_id"),
        "orientation",
        F.col("quality").alias("label"),
        F.concat(F.lit("g"), F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(5)).cast("string")).alias("source"),
        F.when(F.col("doc_id") % 7 != 0, F.floor((hash_fraction(F.col("doc_id").cast("string"), F.lit("id")) * 0.4 + 0.6) * 10000) / 10000).alias("max_id_train"),
        F.when(F.col("doc_id") % 5 != 0, F.floor((hash_fraction(F.col("doc_id").cast("string"), F.lit("local")) * 0.2 + 0.8) * 10000) / 10000).alias("max_id_train_local"),
        ((F.floor((hash_fraction(F.col("doc_id").cast("string"), F.col("orientation")) * 500)) + 300 * F.col("quality")) / 1000).alias("prob"),
    )


FRACTION = "(('0x' || substr(sha256({0}), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE)"
PRED = f"""pred AS (SELECT l.doc_id * 2 + (o = 'rc')::INT AS row_idx, l.doc_id AS window_id, o AS orientation, quality AS label,
  'g' || (regexp_extract(source, '([0-9]+)', 1)::INT % 5) AS source,
  CASE WHEN l.doc_id % 7 <> 0 THEN floor(({FRACTION.format("l.doc_id || ':id'")} * 0.4::DOUBLE + 0.6::DOUBLE) * 10000) / 10000 END AS max_id_train,
  CASE WHEN l.doc_id % 5 <> 0 THEN floor(({FRACTION.format("l.doc_id || ':local'")} * 0.2::DOUBLE + 0.8::DOUBLE) * 10000) / 10000 END AS max_id_train_local,
  (floor({FRACTION.format("l.doc_id || ':' || o")} * 500) + 300 * quality) / 1000 AS prob
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id, (VALUES ('fwd'), ('rc')) AS v(o))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal texts, and made-up links by id as in the SQL; ``held_edges`` has the test items."""
    docs = table(spark, sf_dir, "documents")
    same = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("least"))
    chained = docs.select("doc_id", F.sha2("text", 256).alias("h")).join(same, "h").where("doc_id > least").selectExpr("concat('d', doc_id) AS src", "concat('d', least) AS dst")
    near = docs.where("doc_id % 10 = 1").selectExpr("concat('d', doc_id) AS src", "concat('d', doc_id - 1) AS dst")
    keyed = docs.selectExpr("concat('d', doc_id) AS src", "concat('k', doc_id % 97, ':', source) AS dst").where("src LIKE '%7'")
    return chained.union(near).union(keyed)


def held_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal texts, and every document with each test item that it holds."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    same = own.groupBy("h").agg(F.min("doc_id").alias("least"))
    equal = own.join(same, "h").where("doc_id > least").selectExpr("concat('d', doc_id) AS src", "concat('d', least) AS dst")
    held = contained_items(docs, table(spark, sf_dir, "benchmark")).selectExpr("concat('d', doc_id) AS src", "concat('k', item_id) AS dst")
    return equal.union(held)


EDGES = """edges AS (SELECT 'd' || d.doc_id AS src, 'd' || s.least AS dst FROM documents d JOIN (SELECT text, min(doc_id) AS least FROM documents GROUP BY text) s ON d.text = s.text WHERE d.doc_id > s.least
  UNION ALL SELECT 'd' || doc_id, 'd' || (doc_id - 1) FROM documents WHERE doc_id % 10 = 1
  UNION ALL SELECT 'd' || doc_id, 'k' || (doc_id % 97) || ':' || source FROM documents WHERE ('d' || doc_id) LIKE '%7')"""
HELD_EDGES = """edges AS (SELECT 'd' || d.doc_id AS src, 'd' || s.least AS dst FROM documents d JOIN (SELECT text, min(doc_id) AS least FROM documents GROUP BY text) s ON d.text = s.text WHERE d.doc_id > s.least
  UNION ALL SELECT 'd' || doc_id, 'k' || item_id FROM documents d, benchmark b WHERE contains(d.text, b.text))"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenth sequence the whole, 400 letters of it reversed and complemented, or 150 letters of it: (id, seq)."""
    x = dna(spark, sf_dir).where("doc_id % 10 = 1")
    other = "reverse(translate(substr(seq, 301, 400), 'ACGT', 'TGCA'))"
    return x.selectExpr("concat('q', doc_id) AS id", f"CASE doc_id % 3 WHEN 0 THEN seq WHEN 1 THEN {other} ELSE substr(seq, 501, 150) END AS seq")


#: (query, target) with the places that fragments take, and how many letters differ: no gaps, so a distance of letters says all.
FRAGMENT_HITS = """frag AS (SELECT doc_id, seq AS whole, CASE doc_id % 3 WHEN 0 THEN seq WHEN 1 THEN substr(seq, 301, 400) ELSE substr(seq, 501, 150) END AS seq FROM dna WHERE doc_id % 10 = 1),
near AS (SELECT q.doc_id AS q, t.doc_id AS t, length(q.seq) AS n, hamming(q.seq, CASE q.doc_id % 3 WHEN 0 THEN t.seq WHEN 1 THEN substr(t.seq, 301, 400) ELSE substr(t.seq, 501, 150) END) AS differ
  FROM frag q, dna t WHERE t.doc_id % 10 <> 1),
fragment_hits AS (SELECT 'q' || q AS query, 't' || t AS target, CASE WHEN q % 3 = 1 THEN '-' ELSE '+' END AS strand, (2 * n - 5 * differ)::BIGINT AS score, (n - differ) / n AS fident, n::BIGINT AS alnlen, 1.0::DOUBLE AS qcov, n / 1024 AS tcov
  FROM near WHERE differ * 10 <= n AND n / 1024 >= 0.19)"""
