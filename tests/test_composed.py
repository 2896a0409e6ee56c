"""Configured values, staged runs, publishing, embeddings, planted motifs, and hot keys."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import options, tokens
from strandline.operators import containment, evaluation, extraction, features, grouping, markov, planted, provenance, reports, sampling, similarity, staged
from strandline.sources import readers, sinks


def test_options():
    assert options.items(" a, ,b ") == ["a", "b"] and options.items(None) == []
    assert options.mix("te=0.5,bg=0.5", ("te", "bg")) == {"te": 0.5, "bg": 0.5}
    assert options.fractions("0.7,0.1,0.2") == (0.7, 0.1, 0.2)
    for bad in (lambda: options.mix("te=1", ("te", "bg")), lambda: options.mix("te=0.5,te=0.5", ("te",)), lambda: options.mix("te=0.6,bg=0.5", ("te", "bg")), lambda: options.fractions("0.5,0.5"), lambda: options.fractions("1.2,-0.2,0"), lambda: options.fractions("nan,0.5,0.5")):
        with pytest.raises(ValueError):
            bad()
    options.settings(1024, 512, 0.1, ["chr1"], ["chr2"], ["chr1", "chr2", "chr3"])
    for bad in ((1000, 512, 0.1, [], [], ["a"]), (1024, 0, 0.1, [], [], ["a"]), (1024, 512, 1.0, [], [], ["a"]), (1024, 512, 0.1, ["a"], ["a"], ["a", "b"]), (1024, 512, 0.1, ["a"], ["b"], ["a", "b"])):
        with pytest.raises(ValueError):
            options.settings(*bad)
    assert options.pool_sizes({"train": 10, "test": 3}, 0.35) == {"train": 7, "test": 5}


def test_stages_always_report(spark, tmp_path):
    def good(figures):
        figures["n"] = 3
        return "fine"

    def bad(figures):
        figures["seen"] = 1
        raise staged.StageFailure("not so")

    path = str(tmp_path / "report")
    assert staged.staged_run(spark, [("a", good, True), ("b", bad, False)], path) == 2
    assert staged.staged_run(spark, [("a", good, True)], path) == 0
    assert staged.staged_run(spark, [("a", good, True), ("b", bad, True), ("c", good, False)], path) == 1
    rows = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert [(r["stage"], r["status"]) for r in rows] == [("a", "PASS"), ("b", "FAIL"), ("c", "SKIP")] and rows[1]["figures"] == {"seen": 1}

    def interrupted(figures):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        staged.staged_run(spark, [("a", good, True), ("b", interrupted, True)], path)
    assert [json.loads(r["value"])["stage"] for r in spark.read.text(path).collect()] == ["a"]


def test_readers_find_one_version(spark, tmp_path):
    path = str(tmp_path / "set")
    one = spark.createDataFrame([(1,)], "a int")
    first = sinks.publish(spark, {"t": one}, path, meta={"seed": 42})
    assert sinks.published(spark, path) == first and spark.read.parquet(f"{first}/t").count() == 1
    broken = lambda t: spark.createDataFrame([("rule", 2)], "check string, violations long")
    with pytest.raises(ValueError, match="rule"):
        sinks.publish(spark, {"t": one.union(one)}, path, checks=broken)
    assert sinks.published(spark, path) == first
    second = sinks.publish(spark, {"t": one.union(one)}, path)
    assert sinks.published(spark, path) == second != first and spark.read.parquet(f"{second}/t").count() == 2
    assert json.loads(spark.read.text(f"{first}/meta").first()["value"])["rows"] == {"t": 1}


def test_embeddings_keep_their_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i // 2}", "fwd" if i % 2 == 0 else "rc", i % 2, "l1", None if i else 0.5, 0.25) for i in range(6)], "row_idx long, window_id string, orientation string, label int, source string, max_id_train double, max_id_train_local double")
    vectors = rows.withColumn("embedding", F.array(F.col("row_idx").cast("float"), F.lit(1 / 3)))
    path = str(tmp_path / "emb")
    sinks.write_embeddings(vectors, path, dims=2)
    out = readers.read_embeddings(spark, path, rows, 2).orderBy("row_idx").collect()
    assert [list(r["embedding"]) for r in out] == [[float(i), pytest.approx(1 / 3, rel=1e-3)] for i in range(6)]
    other = rows.withColumn("label", F.when(F.col("row_idx") == 3, 0).otherwise(F.col("label")))
    for wrong, dims in ((other, 2), (rows.where("row_idx < 5"), 2), (rows, 3)):
        with pytest.raises(Exception, match="don't fit"):
            readers.read_embeddings(spark, path, wrong, dims).collect()
    for bad in ([70000.0, 1.0], [float("nan"), 1.0], [1.0]):
        with pytest.raises(Exception, match="embedding"):
            sinks.half_precision(spark.createDataFrame([(bad,)], "embedding array<float>"), dims=2).collect()
    assert sinks.half_precision(vectors.limit(0)).count() == 0
    moments = features.moments(vectors.withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding")
    document = json.loads(sinks.probe_document([0.1, 0.2], 0.5, moments, 1.0, 0.4))
    assert len(document["mean"]) == 2 and document["c"] == 1.0


def test_labels_of_any_number(spark):
    rows = lambda x: spark.createDataFrame([("ACGT", x)], "sequence string, label string")
    assert readers.labelled_rows(rows(" -7 ")).first()["label"] == -7
    for bad in ("1.5", "x", "", None):
        with pytest.raises(Exception, match="label"):
            readers.labelled_rows(rows(bad)).collect()


def test_words_are_cut_anew_after_an_n(spark):
    of = lambda s: spark.createDataFrame([(s,)], "s string").select(tokens.words(F.col("s")).alias("w")).first()["w"]
    assert of("ACGTACGTACGTAC") == ["ACGTAC", "GTACGT", "A", "C"] and of("ACGNACGTAC") == ["A", "C", "G", "N", "ACGTAC"]
    assert of("acgtACGTAC") == ["<unk>", "ACGTAC"] and of("") == [] and of(None) is None
    assert tokens.vocabulary_size() == 4107


def test_motifs_are_planted(spark):
    motifs = {0: ("TTTTTTTTTT",), 1: ("GGGGGGGGGG", "CCCCCCCCCC")}
    rows = spark.range(51).withColumnRenamed("id", "row")
    out = planted.planted(rows, motifs, 60, gc=0.4).collect()
    assert collections.Counter(r["label"] for r in out) == {0: 26, 1: 25}
    assert all(len(r["sequence"]) == 60 and all(m in r["sequence"] for m in motifs[r["label"]]) for r in out)
    assert sorted(map(tuple, planted.planted(rows.repartition(7), motifs, 60, gc=0.4).collect())) == sorted(map(tuple, out))
    with pytest.raises(ValueError, match="both"):
        planted.disjoint(("ACGTACGT",), ("TACGTACA",), 6)
    with pytest.raises(ValueError, match="no room"):
        planted.places([6, 6], 8, planted.numbers("x"))


def test_equal_sequences_beyond_a_thousand_are_linked(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(80))
    other = "".join(rng.choice("ACGT") for _ in range(80))
    rows = [(i, base) for i in range(1001)] + [(2000, other), (2001, None), (2002, "ACGT")]
    df = spark.createDataFrame(rows, "id long, seq string")
    assert similarity.cluster_pairs(df, "id").count() == 1001 * 1000 // 2
    best = similarity.best_identity(df.where("id >= 999"), df.where("id < 999"), "id").collect()
    assert {r["query"]: r["max_id"] for r in best} == {999: 1.0, 1000: 1.0, 2000: 0.0, 2001: 0.0, 2002: 0.0}


def test_kmers_of_both_strands_are_one():
    rng = random.Random(8)
    for k in (3, 16):
        s = "".join(rng.choice("ACGTN") for _ in range(60))
        rc = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert (similarity.canonical(s, k) == similarity.canonical(rc, k)).all()
        flip = lambda w: w.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert len(similarity.canonical(s, k)) == len({min(w, flip(w)) for w in (s[i : i + k] for i in range(len(s) - k + 1))})
    assert len(similarity.canonical("ACG", 16)) == 0


def test_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox jumps over the lazy dog yy"), (2, "the quick brown fox jumps over the lazy cat"), (3, ""), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "quick"), (3, ""), (4, None), (5, "quick")], "item_id long, text string")
    want = {(1, 1), (1, 2), (2, 2), (1, 5), (2, 5), (1, 3), (2, 3), (3, 3)}
    for block in (1, 100):
        assert {tuple(r) for r in containment.contained_items(docs, items, block).collect()} == want
    assert containment.contained_items(docs.limit(0), items).count() == 0


def test_generated_letters_follow_the_model(spark):
    import numpy as np

    x = spark.createDataFrame([("ACACACACAC" * 20,)] * 3, "seq string")
    made = markov.generate(markov.transitions(x, 2), markov.initials(x, 2), 50, 40, 2).collect()
    pairs = collections.Counter(s[i : i + 3] for r in made for s in [r["seq"]] for i in range(len(s) - 2))
    assert len(made) == 50 and (pairs["ACA"] + pairs["CAC"] + pairs["GTG"] + pairs["TGT"]) / sum(pairs.values()) > 0.9
    again = markov.generate(markov.transitions(x, 2), markov.initials(x, 2), 50, 40, 2).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))
    u, t = np.array([2**32 - 1, 12345]), np.array([2**52 + 7, 3])
    assert markov.scaled(u, t).tolist() == [int(a) * int(b) >> 32 for a, b in zip(u, t, strict=True)]
    assert markov.generate(markov.transitions(x.limit(0), 2), markov.initials(x.limit(0), 2), 5, 10, 2).count() == 0


def test_histograms_fall_back(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "role string, bin int")
    out = {(r["role"], r["bin"]): r["frac"] for r in sampling.histogram(rows, "role", "bin", ("a", "b", "c")).collect()}
    assert out == {("a", 1): 0.5, ("a", 2): 0.5, ("b", 1): 1.0, ("c", 1): pytest.approx(2 / 3), ("c", 2): pytest.approx(1 / 3)}
    assert sampling.histogram(rows.limit(0), "role", "bin", ("a",)).count() == 0


def test_union_of_windows_has_no_repeats(spark):
    a, b = spark.createDataFrame([("x", 1)], "window_id string, v int"), spark.createDataFrame([("y", 2), ("x", 3)], "window_id string, v int")
    with pytest.raises(ValueError, match="more than once"):
        extraction.union_windows(a, b)
    assert extraction.union_windows(a, b.where("v = 2")).count() == 2
    assert {tuple(r) for r in extraction.distinct_windows(a, b).collect()} == {("x", 1), ("y", 2)}


def test_overlap_of_official_sides(spark):
    train = spark.createDataFrame([("A", "t0", 0), ("B", "t1", 1), (None, "t2", 1), ("A", "t3", 0)], "sequence string, name string, label int")
    test = spark.createDataFrame([("A", "x", 1), ("A", "a", 0), ("C", "y", 0), (None, "z", 1)], "sequence string, name string, label int")
    assert [(r["sequence"], [tuple(x) for x in r["rows"]]) for r in grouping.shared_sequences(train, test).collect()] == [("A", [("a", 0), ("x", 1)])]
    assert sorted(r["name"] for r in grouping.without_shared(train, test).collect()) == ["t1", "t2"]


def test_reuse_needs_equal_settings_and_files(spark):
    found = spark.createDataFrame([("train", "h1")], "dataset string, sha256 string")
    meta = {"settings": {"seed": 1}, "sha256": {"train": "h1"}}
    assert provenance.unchanged({"seed": 1}, meta, found)
    assert not provenance.unchanged({"seed": 2}, meta, found) and not provenance.unchanged({"seed": 1}, None, found)
    assert not provenance.unchanged({"seed": 1}, {**meta, "sha256": {"train": "h2"}}, found) and not provenance.unchanged({"seed": 1}, {"settings": {"seed": 1}}, found)


def test_leaks_are_told_by_rule(spark):
    kind = "dataset string, window_id string, group string, chrom string, holdout boolean, dev_chrom boolean, seq string, label int"
    clean = [("train", "a", "g1", "chr1", False, False, "ACGT", 1), ("dev", "b", "g2", "", False, False, "ACGT", 0), ("test", "c", "g3", "chr2", True, False, "ACGT", 1)]
    of = lambda rows, **kw: {r["check"]: r["violations"] for r in grouping.leak_checks(spark.createDataFrame(rows, kind), 4, **kw).collect() if r["violations"]}
    assert of(clean) == {} and len(grouping.leak_checks(spark.createDataFrame(clean, kind), 4).collect()) == 13
    assert of([*clean, ("test", "a", "g1", "", False, False, "ACGT", 1)]) == {"window_in_train_and_other": 1, "group_in_test_and_train_dev": 1}
    assert of([*clean, clean[0]]) == {"repeated_in_a_set": 1}
    assert of([*clean, ("dev", "d", "g4", "chr3", False, False, "ACGN", 2)], mode="chrom") == {"genomic_not_dev_chrom_in_dev": 1, "invalid_sequence": 1, "invalid_label": 1}
    shared = [*clean, ("test", "e", "g1", "", False, False, "ACGT", 1)]
    assert grouping.failed_checks(grouping.leak_checks(spark.createDataFrame(shared, kind), 4)) == []
    assert grouping.failed_checks(grouping.leak_checks(spark.createDataFrame(shared, kind), 4, purged=True)) == ["group_in_test_and_train_dev = 1"]
    assert all(r["violations"] == 0 for r in grouping.leak_checks(spark.createDataFrame([], kind), 4).collect())


def test_reports_of_empty_tables(spark):
    kind = "window_id string, source string, subfamily string, chrom string, dataset string, label int, gc int, group string, max_id_train double, max_id_train_local double"
    none = spark.createDataFrame([], kind)
    assert [tuple(r) for r in reports.strict_loss(none, none).collect()] == [(None, 0, 0, None)]
    assert reports.identity_against_strict(none, none).first()["n"] == 0
    for empty in (reports.largest_group(none), reports.composition(none, "source"), reports.chromosomes_of(none), reports.gc_balance(none, 128), reports.most_common(none, "source", 3)):
        assert empty.count() == 0
    one = spark.createDataFrame([("w", "l1", "s", "chrX", "train", 1, 64, "g", 0.5, 0.96)], kind)
    assert tuple(reports.gc_balance(one, 128).first()) == ("train", 50.0, None, None)
    assert evaluation.multiclass_summary(one.selectExpr("1 AS y", "1 AS p"), "y", "p").first()["mcc"] == 0.0
    epochs = spark.createDataFrame([(1, float("nan"), 0.5)], "epoch int, loss double, f1 double")
    rows = spark.createDataFrame([("ACGTx", 1, ["<unk>"])], "sequence string, label int, tokens array<string>")
    assert tuple(reports.diagnosis(rows, epochs).first()) == (1, 1, 1, 1, "nan", 1)
    assert reports.diagnosis(rows, epochs.limit(0)).first()["loss_trend"] is None


def test_reports_are_printed(spark):
    df = spark.createDataFrame([("b", 0.5, None), ("a", 1.0, 3)], "name string, x double, n int")
    assert reports.printed(df, "figures", ["name"]) == "=== figures ===\nname  x       n\na     1.0000  3\nb     0.5000  -"
    assert reports.printed(df, "figures", ["name"], 1).endswith("... 2 rows")


def test_perceptron_learns(spark):
    rows = [([float(i % 7), float(i % 5)], int(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    model = features.mlp_probe(df, 2, hidden=8)
    from pyspark.ml.functions import array_to_vector

    out = model.transform(df.withColumn("__v", array_to_vector("features")))
    assert out.where("prediction = label").count() > 180
