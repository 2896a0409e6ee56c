"""The queries of this package, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import fold, partitions, table
from strandline.llm.tokens import vocabulary

#: Documents with a lower quality score are rejected.
QUALITY = 0.7


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.audio import fingerprint, played

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.repartition(partitions(vectors)).select("vec_id", fingerprint(F.col("embedding"), decode=played).alias("prints"))


def op1_chroma_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is played as a clip; every 20th asks for the clips that sound like it."""
    from strandline.llm.audio import search

    return search(_clips(spark, sf_dir), F.col("vec_id") % 20 == 0, id_col="vec_id").withColumnRenamed("id", "vec_id")


def op1_chroma_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes of clips that a query's class matches; op1_chroma_search has the clips of a class."""
    from strandline.llm.audio import match_pairs

    return match_pairs(_clips(spark, sf_dir), F.col("vec_id") % 20 == 0, id_col="vec_id")


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "byte")


def op3_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WS}), '[\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
  FROM w WHERE words IS NOT NULL AND words <> ['']
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS doc_id, x AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x),
m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.contamination import find_contained

    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CONTAINMENT_SQL = """
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(length(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
  FROM w WHERE words IS NOT NULL AND words <> ['']
), n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM s d JOIN s b ON d.shingle = b.shingle AND d.side = 'd' AND b.side = 'b' JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n_shingles)
"""


def op5_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.records import read_index, write_records

    path = write_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "word")
    return read_index(spark, path)


def op6_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= QUALITY).cast("int"))


def op8_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm import languages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = languages.fit(docs)
    out = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), languages.predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op7_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


LINES_SQL = """
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), g AS (
  SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE top IS NOT NULL AND top <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN g USING (k) GROUP BY doc_id
"""


def op9_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.suffixes import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


REPEATS_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), z AS (SELECT doc_id, b, octet_length(b) AS n FROM b),
s AS (SELECT doc_id, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS i FROM z WHERE n >= 400)),
g AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS f FROM s SEMI JOIN g USING (h)),
k AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM k GROUP BY doc_id, k),
p AS (SELECT doc_id, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), n) AS hi FROM r JOIN z USING (doc_id) UNION ALL SELECT doc_id, 0, coalesce((SELECT min(lo) FROM r WHERE r.doc_id = z.doc_id), n) FROM z),
kept AS (SELECT doc_id, unhex(string_agg(hex(b[lo + 1:hi]), '' ORDER BY lo)) AS kept FROM p JOIN z USING (doc_id) GROUP BY doc_id)
SELECT z.doc_id, n AS n_bytes, coalesce((SELECT sum(hi - lo) FROM r WHERE r.doc_id = z.doc_id), 0)::BIGINT AS n_removed, (SELECT count(*) FROM r WHERE r.doc_id = z.doc_id) AS n_spans, sha256(kept) AS kept_sha256 FROM z JOIN kept USING (doc_id)
"""


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.whitening import by_component, whiten

    return by_component(whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op12_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.windows import remove_windows

    out = remove_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


WINDOWS_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p, true AS gone FROM r),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM w)
SELECT w.doc_id, any_value(len(w.w))::BIGINT AS n_words, count(gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY t.p) FILTER (WHERE word IS NOT NULL AND gone IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY w.doc_id
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.audit import audit

    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


AUDIT_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), m AS (
  SELECT part, concat(
      CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
      CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN t.doc_id > first THEN 'E' END) AS f,
    count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM t LEFT JOIN labels USING (doc_id) GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x
), s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
c AS (
  SELECT part, filter_order, step, letter, n, good, toxic, f, contains(f, letter) AS here, length(translate(before, f, '')) < length(before) AS gone FROM m, s
), k AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE f = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0) AS toxic_lost
  FROM c GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chroma_search, op1_chroma_pairs, op2_cost_balanced_packing, op3_partenum_jaccard, op4_minhash_containment, op5_record_files, op6_quality_rff, op7_line_bitmaps, op8_language_ftrl, op9_suffix_merge, op10_secret_ownership, op11_embedding_whitening, op12_window_dedup, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_partenum_jaccard": JACCARD_SQL, "op4_minhash_containment": CONTAINMENT_SQL, "op7_line_bitmaps": LINES_SQL, "op9_suffix_merge": REPEATS_SQL, "op12_window_dedup": WINDOWS_SQL, "op13_filter_audit": AUDIT_SQL}
