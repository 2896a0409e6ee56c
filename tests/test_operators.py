"""Operators against hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import evaluation, features, grouping, intervals, markov, provenance, sampling, similarity
from strandline.operators.containment import contained_items
from strandline.operators.graph import connected_components
from strandline.operators.scan import running_sums
from strandline.sources import readers, sinks


def iv(spark, *spans, chrom="c"):
    return spark.createDataFrame([(chrom, a, b) for a, b in spans], "chrom string, start long, end long")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


@pytest.mark.parametrize("bucket", [1, 7, 1 << 16])
def test_merge_coverage_gaps(spark, bucket):
    m = intervals.merged(iv(spark, (15, 30), (10, 20), (40, 50), (60, 60)), bucket=bucket)
    assert got(m) == [("c", 10, 30), ("c", 40, 50)]
    w = iv(spark, (0, 100), (25, 45), (30, 40), (29, 41))
    assert got(intervals.coverage(w, m, bucket=bucket), "start", "end", "covered") == [(0, 100, 30), (25, 45, 10), (29, 41, 2), (30, 40, 0)]
    assert got(intervals.gaps(m, iv(spark, (0, 60)), bucket=bucket), "gap_start", "gap_end") == [(0, 10), (30, 40), (50, 60)]
    assert got(intervals.gaps(intervals.merged(iv(spark, (0, 60))), iv(spark, (0, 60)))) == []


@pytest.mark.parametrize("bucket", [100, 1 << 16])
def test_clusters(spark, bucket):
    rows = [("c", "+", 0, 100), ("c", "+", 600, 700), ("c", "+", 1201, 1300), ("c", "-", 650, 690)]
    out = intervals.clusters(spark.createDataFrame(rows, "chrom string, strand string, start long, end long"), bucket=bucket)
    assert got(out, "strand", "start", "end") == [("+", 0, 700), ("+", 1201, 1300), ("-", 650, 690)]


def test_a_pair_comes_out_once(spark):
    out = intervals.overlaps(iv(spark, (0, 1000)), iv(spark, (5, 900), (999, 2000), (1000, 1100)), bucket=10)
    assert got(out, "start_b", "overlap") == [(5, 895), (999, 1)]


def test_window_starts(spark):
    cases = [(1000, 1300, 9999), (100, 300, 9999), (0, 2500, 9999), (0, 2048, 9999), (4900, 5000, 5000), (0, 10, 50)]
    df = spark.createDataFrame(cases, "a long, b long, n long").select("a", "b", S.window_starts(F.col("a"), F.col("b"), 1024, 512, F.col("n")).alias("s"))
    found = {(r["a"], r["b"]): r["s"] for r in df.collect()}
    assert found == {(1000, 1300): [638], (100, 300): [0], (0, 2500): [0, 512, 1024, 1476], (0, 2048): [0, 512, 1024], (4900, 5000): [3976], (0, 10): []}


def test_figures(spark):
    df = spark.createDataFrame([(0,), (1024,), (512,)], "gc long")
    assert [r[0] for r in df.select(S.gc_bin(F.col("gc"), F.lit(1024))).collect()] == [0, 49, 25]
    ids = spark.createDataFrame([(x,) for x in (0.0, 0.7999, 0.80, 0.8999, 0.90, 0.9499, 0.95, 1.0, None)], "x double")
    assert [r[0] for r in ids.select(S.identity_band(F.col("x"))).collect()] == ["<0.80"] * 2 + ["0.80-0.90"] * 2 + ["0.90-0.95"] * 2 + [">=0.95"] * 2 + [None]
    one = spark.range(1)
    assert one.select(S.fixed(F.lit(32 / 1024), 4)).first()[0] == "0.0312"
    assert one.select(S.kmers(F.lit("AC"), 3), S.kmers(F.lit("ACGT"), 3)).first()[:] == ([], ["ACG", "CGT"])
    assert one.select(S.only_acgt(F.lit(""))).first()[0] is True
    assert one.select(S.reverse_complement(F.lit("AACG"))).first()[0] == "CGTT"
    import hashlib

    assert one.select(S.hash_fraction(F.lit("42"), F.lit("g"))).first()[0] == int(hashlib.sha256(b"42:g").hexdigest()[:15], 16) / 16**15
    assert int(one.select(S.seed64(F.lit("42"))).first()[0]) == int(hashlib.sha256(b"42").hexdigest()[:16], 16)


def test_best_hits(spark):
    rows = [("q0", 0.93, 900, 0.9), ("q0", 0.99, 250, 0.2), ("q1", 0.99, 100, 0.1), ("q1", 0.9, 199, 0.79)]
    df = spark.createDataFrame(rows, "query string, fident double, alnlen long, qcov double")
    assert got(similarity.best_hits(df)) == [("q0", 0.93, 0.99), ("q1", 0.0, 0.0)]


def test_common_kmers_bring_pairs_together(spark):
    rng = random.Random(5)
    x = "".join(rng.choice("ACGT") for _ in range(120))
    near = [x[:i] + {"A": "C", "C": "G", "G": "T", "T": "A"}[x[i]] + x[i + 1 :] for i in range(8)]
    seqs = [*near, *near[:4], x, "".join(rng.choice("ACGT") for _ in range(120))]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    sets = [{min(s[i : i + 16], s[i : i + 16][::-1].translate(str.maketrans("ACGT", "TGCA"))) for i in range(len(s) - 15)} for s in seqs]
    own = similarity.kmer_sets(df, "id")
    want = [(a, b, len(p & q), len(p), len(q)) for a, p in enumerate(sets) for b, q in enumerate(sets) if p & q]
    for most in (3, 1000):  # k-mers of more ids than that are dealt out, not left out
        assert got(similarity.shared_kmers(own, own, most)) == sorted(want)


def test_large_groups_keep_their_links(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(2)]
    df = spark.range(1002).selectExpr("id", f"IF(id < 1001, '{seqs[0]}', '{seqs[1]}') AS seq")
    assert similarity.cluster_pairs(df, "id").count() == 1001 * 1000 // 2
    best = similarity.best_identity(df.where("id % 500 = 0"), df.where("id % 500 <> 0").union(df.selectExpr("id + 5000", "seq")), "id")
    assert got(best) == [(0, 1.0), (500, 1.0), (1000, 1.0)]


def test_best_identity_keeps_low_ones(spark):
    rng = random.Random(7)
    x, y = ("".join(rng.choice("ACGT") for _ in range(300)) for _ in range(2))
    queries = spark.createDataFrame([(0, x), (1, y[:56]), (2, y[:80])], "id long, seq string")
    targets = spark.createDataFrame([(10, x[:18] + x[18:300][::-1]), (11, y)], "id long, seq string")
    out = dict(got(similarity.best_identity(queries, targets, "id")))
    assert 0.5 <= out[0] < 0.8  # few k-mers of many
    assert (out[1], out[2]) == (0.0, 1.0)  # 41 and 65 k-mers of 285: coverages of 0.14 and 0.23


def test_whole_items_in_blocks(spark):
    start = "a question that starts like others do, for sixty letters and more: "
    docs = spark.createDataFrame([(0, f"x {start}seven y"), (1, f"{start}eight"), (2, None), (3, "seven eight")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{start}{w}") for i, w in enumerate(["seven", "eight", "nine"])] + [(3, None)], "item_id long, text string")
    for block, letters in ((1, 1 << 20), (100, 80), (100, 1 << 20)):
        assert got(contained_items(docs, items, block, letters)) == [(0, 0), (1, 1)]
    assert contained_items(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "held"), [(2, 1), (50, 3), (301, 10**6)])
def test_components_of_a_path(spark, n, held):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (None, 3)], "src long, dst long")
    out = connected_components(edges, held=held)
    assert got(out) == [(i, 0) for i in range(n + 1)] + [(1000, 1000)]
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_running_sums_cross_buckets(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), "id", (F.col("id") / 7).cast("int").alias("b"), F.lit(1).alias("x"))
    assert all(r["s"] == r["id"] + 1 for r in running_sums(df, ["k"], "b", ["id"], {"s": "x"}).collect())
    assert all(r["s"] == 100 - r["id"] for r in running_sums(df, ["k"], "b", [F.desc("id")], {"s": "x"}, descending=True).collect())


def scored(spark, rows):
    return spark.createDataFrame(rows, "row_idx long, window_id string, label int, source string, max_id_train double, prob double")


def test_thresholds_and_ranks(spark):
    df = scored(spark, [(i, f"w{i}", y, "s", None, p) for i, (y, p) in enumerate([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])])
    t = evaluation.best_threshold(df, []).first()
    assert (t["threshold"], round(t["mcc"], 9)) == (0.35, round(2 / 12**0.5, 9))
    r = evaluation.ranking(df, []).first()
    assert (r["auroc"], r["auprc"]) == (0.75, 0.8333)
    one = evaluation.binary(df.where("label = 1"), []).first()
    assert one["auroc"] is None and one["auprc"] is None and one["mcc"] == 0


def test_rollup_and_conflict(spark):
    df = scored(spark, [(0, "a", 1, "s", None, 0.2), (1, "b", 0, "s", None, 0.9), (2, "a", 1, "s", None, 0.6), (3, "b", 0, "s", None, 0.1)])
    assert [(r["window_id"], round(r["prob"], 9)) for r in evaluation.by_window(df, ["source"]).orderBy("row_idx").collect()] == [("a", 0.4), ("b", 0.5)]
    with pytest.raises(Exception, match="labels of a window differ"):
        evaluation.by_window(df.union(scored(spark, [(4, "a", 0, "s", None, 0.5)])), []).collect()


def test_band_recall(spark):
    rows = [(0, "a", 1, "l1", 0.5, 0.9), (1, "b", 1, "l1", 0.85, 0.9), (2, "c", 1, "l1", 0.85, 0.1), (3, "d", 1, "l1", None, 0.9), (4, "e", 0, "te", 0.97, 0.9)]
    out = {r["band"]: (r["n"], r["recall"]) for r in evaluation.recall_by_band(scored(spark, rows), "l1").collect()}
    assert out == {"<0.80": (1, 1.0), "0.80-0.90": (2, 0.5), "0.90-0.95": (0, None), ">=0.95": (0, None), "no_value": (1, 1.0)}


def test_balance(spark):
    rows = [(f"p{i}", 1, "l1") for i in range(20)] + [("t0", 0, "te")] + [(f"m{i}", 0, "markov") for i in range(30)] + [(f"b{i}", 0, "background") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, label int, source string").withColumn("g", F.lit(1))
    mix = {"te": 0.35, "markov": 0.35, "background": 0.30}
    t = {r["source"]: (r["taken"], r["deficit"]) for r in sampling.balance_targets(df, ["g"], mix, "background").collect()}
    assert t == {"te": (1, 6), "markov": (7, 0), "background": (12, 0)}
    out = sampling.balanced(df, ["g"], mix, "background", "id")
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {"l1": 20, "te": 1, "markov": 7, "background": 12}


def members(spark):
    rows = [
        ("l1:chr1:0-1024", "A", "chr1", False, False, "l1"),
        ("l1:chr21:0-1024", "A", "chr21", True, False, "l1"),
        ("l1:chr2:0-1024", "B", "chr2", False, False, "l1"),
        ("retrovirus:x:0", "C", "", False, False, "retrovirus"),
        ("l1:chr21:9-1033", "D", "chr21", True, False, "l1"),
        ("l1:chr7:0-1024", "E", "chr7", False, True, "l1"),
    ]
    return spark.createDataFrame(rows, "window_id string, group string, chrom string, holdout boolean, dev_chrom boolean, source string")


def test_split_strict_purge(spark):
    s = grouping.assign_splits(members(spark), "chrom", dev_fraction=0.0, retro=(0.0, 0.0, 1.0))
    assert dict(got(s, "window_id", "split")) == {"l1:chr1:0-1024": "train", "l1:chr21:0-1024": "test", "l1:chr2:0-1024": "train", "retrovirus:x:0": "test", "l1:chr21:9-1033": "test", "l1:chr7:0-1024": "dev"}
    strict = grouping.strict(s)
    assert got(strict.where("is_test_strict"), "window_id") == [("l1:chr21:9-1033",), ("retrovirus:x:0",)]
    assert got(strict.where("is_dev_strict"), "window_id") == [("l1:chr7:0-1024",)]
    assert ("l1:chr1:0-1024",) not in got(grouping.purge(s), "window_id") and grouping.purge(s).count() == 5


def test_groups_never_straddle(spark):
    ids = [f"w{i}" for i in range(200)]
    links = spark.createDataFrame([(ids[(i * 37) % 200], ids[(i * 91 + 5) % 200]) for i in range(60)], "src string, dst string")
    g = grouping.groups(spark.createDataFrame([(i,) for i in ids], "window_id string"), links)
    m = g.withColumns({"chrom": F.lit("chr1"), "holdout": F.lit(False), "dev_chrom": F.lit(False), "source": F.lit("l1")})
    assert grouping.assign_splits(m).groupBy("group").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_markov(spark):
    seqs = spark.createDataFrame([("ACGTACGTAC",), ("TTTTTTTTTT",)], "seq string")
    t, i = markov.transitions(seqs, 3), markov.initials(seqs, 3)
    assert t.agg(F.sum("n")).first()[0] == 2 * 2 * (10 - 3)
    a, b = (markov.generate(t, i, 20, 50, 3).collect() for _ in range(2))
    assert a == b and all(len(r["seq"]) == 50 and not {*r["seq"]} - {*"ACGT"} for r in a)


def test_features(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    assert got(features.moments(df, "v")) == [(0, 2.0, 1.0), (1, 5.0, 1e-6)]
    assert [r["v"] for r in features.standardized(df, "v", features.moments(df, "v")).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert spark.range(1).select(features.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0
    assert features.half_range(spark.createDataFrame([([1.0],), ([70000.0],), ([float("nan")],)], "v array<double>"), "v").count() == 2
    v = spark.createDataFrame([("AAAC",)], "s string").select(features.kmer_vector(F.col("s"))).first()[0]
    assert len(v) == 64 and v[0] == 1 and v[1] == 1 and sum(v) == 2


def test_annotation_errors(spark):
    line = "\t".join(["chr1", "10", "30", "L1", "orf2", "+", "0", "0", "0", "20", "0.9", "0.9"])
    ok = spark.createDataFrame([(line,), ("#c",), (" ",), (line.replace("chr1", "chrUn"),)], "value string")
    assert got(readers.annotation_rows(ok), "chrom", "start", "end") == [("chr1", 10, 30)]
    for bad in (line + "\tx", line.replace("\t20\t", "\t21\t")):
        with pytest.raises(Exception, match="columns expected|length doesn't fit"):
            readers.annotation_rows(spark.createDataFrame([(bad,)], "value string")).collect()
    other = line.replace("chr1", "chrUn").replace("\t20\t", "\t21\t")
    assert readers.annotation_rows(spark.createDataFrame([(other,)], "value string")).count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">NC_1.1 |pol protein [F]|y\nACGT\nacgn\n>NC_2.1 none\nTT\n")
    fa = readers.read_fasta(spark, str(tmp_path / "x.fa"))
    assert got(fa, "name", "seq") == [("NC_1.1", "ACGTACGN"), ("NC_2.1", "TT")]
    assert got(readers.product_records(fa), "name", "product") == [("NC_1.1", "pol protein")]
    rows = [("w1", "ACGT", 2, 1, "l1", "", "chr1", 0, 4, "+", "g", 0.5, None)]
    w = spark.createDataFrame(rows, "window_id string, seq string, gc long, label int, source string, detail string, chrom string, start long, end long, strand string, group string, max_id_train double, max_id_train_local double")
    sinks.write_csv(sinks.contract_rows(w, 4), str(tmp_path / "d"))
    back = readers.read_dataset(spark, str(tmp_path / "d"))
    assert got(back, "sequence", "orientation", "label", "max_id_train", "max_id_train_local") == [("ACGT", "fwd", 1, 0.5, None), ("ACGT", "rc", 1, 0.5, None)]
    with pytest.raises(Exception, match="bad sequence"):
        sinks.contract_rows(w, 5).collect()
    path = str(tmp_path / "out")
    none = lambda t: spark.createDataFrame([("r", 0)], "check string, violations long")
    some = lambda t: spark.createDataFrame([("r", 2)], "check string, violations long")
    sinks.publish(spark, {"t": w}, path, none, {"a": 1})
    with pytest.raises(ValueError, match="nothing published"):
        sinks.publish(spark, {"t": w.limit(0)}, path, some)
    assert spark.read.parquet(f"{sinks.published(spark, path)}/t").count() == 1
    sinks.publish(spark, {"t": w.limit(0)}, path, none)
    assert spark.read.parquet(f"{sinks.published(spark, path)}/t").count() == 0
    assert readers.read_metadata(spark, str(tmp_path / "nowhere")) is None


def test_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_bytes(b"abc")
    assert provenance.file_hashes(spark, str(tmp_path / "a")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    m, f = (spark.createDataFrame(x, "dataset string, sha256 string") for x in ([("a", "1"), ("b", "2")], [("a", "9"), ("c", "3")]))
    assert got(provenance.verified(m, f)) == [("a", "changed"), ("b", "missing"), ("c", "unexpected")]


def test_sessions_stream(spark, tmp_path):
    from strandline.streaming.sessions import sessions

    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:20:00", 2.0), (1, "2024-01-01 02:00:00", 4.0), (1, "2024-01-02 02:00:00", 8.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS ts", "value")
    assert got(sessions(df), "n_events", "total") == [(1, 4.0), (1, 8.0), (2, 3.0)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream).writeStream.format("memory").queryName("s").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got(spark.table("s"), "n_events", "total") == [(1, 4.0), (2, 3.0)]  # the last is still open


def test_overlaps_of_all_lengths_are_those_of_all_pairs(spark):
    rng = random.Random(5)

    def draw(n):
        out = []
        for _ in range(n):
            length = int(4 ** rng.uniform(0, 14)) - 1
            start = rng.randrange(0, 1 << 28 if rng.random() < 0.5 else 1 << 14)
            out.append((start, start + length))
        return out + [(0, 1 << 28), (0, 1 << 28), (4096, 8192), (4095, 4096), (5, 5), ((1 << 28) - 1, 1 << 28)]

    a, b = draw(150), draw(150)
    want = sorted((*x, *y, min(x[1], y[1]) - max(x[0], y[0])) for x in a for y in b if x[1] > x[0] and y[1] > y[0] and min(x[1], y[1]) > max(x[0], y[0]))
    for bucket in (1, 64, intervals.BIN):
        if bucket == 1:  # bins of one base: the top level's are of 2^16, and longer intervals lie on more of them
            few = [(x, y) for x, y in a if y - x < 1 << 16 and y < 1 << 20]
            assert got(intervals.overlaps(iv(spark, *few), iv(spark, *b), bucket=bucket), "start", "end", "start_b", "end_b", "overlap") == [w for w in want if w[:2] in set(few)]
        else:
            assert got(intervals.overlaps(iv(spark, *a), iv(spark, *b), bucket=bucket), "start", "end", "start_b", "end_b", "overlap") == want
    assert got(intervals.overlaps(iv(spark, *a), iv(spark).where("false"))) == []


def test_rows_dealt_grow_with_the_intervals_and_not_with_their_lengths(spark):
    spans = [(i, i + (1 << 27)) for i in range(50)]
    long, short = iv(spark, *spans), iv(spark, *((i * 5000, i * 5000 + 100) for i in range(1000)))
    held = F.lit(0b1001)
    assert intervals._dealt(long, "start", "end", intervals.BIN, held, 0).count() <= 50 * (intervals.SPREAD + 1)
    assert intervals._dealt(short, "start", "end", intervals.BIN, held, 1).count() <= 1000 * 4
    assert intervals.overlaps(long, short).count() == sum(a < y and x < b for a, b in spans for x, y in ((i * 5000, i * 5000 + 100) for i in range(1000)))


def test_the_first_list_that_touches(spark):
    w = iv(spark, (0, 10), (20, 30), (40, 50), (60, 70), (60, 70), (80, 80))
    out = intervals.untouched(w, [("p", iv(spark, (5, 6), (65, 66), (0, 3))), ("q", iv(spark, (0, 45), (80, 90)))])
    assert sorted((r["start"], r["reason"] or "") for r in out.collect()) == [(0, "p"), (20, "q"), (40, "q"), (60, "p"), (60, "p"), (80, "")]
