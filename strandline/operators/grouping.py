"""Groups of related windows, their splits, strict subsets, and the checks before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import by_fractions, hash_fraction
from strandline.operators.graph import connected_components

SPLITS = ("train", "dev", "test")
TEST, DEV = ("test", "test_strict"), ("dev", "dev_strict")


def group_id(least: Column) -> Column:
    return F.concat(F.lit("g_"), F.substring(F.sha1(least.cast("binary")), 1, 12))


def groups(windows: DataFrame, links: DataFrame, id_col: str = "window_id") -> DataFrame:
    """(window_id, group): windows that links (src, dst) or shared keys among them connect; named after their smallest window."""
    found = connected_components(links)
    own = windows.select(id_col).join(found.withColumnRenamed("node", id_col), id_col, "left").withColumn("component", F.coalesce("component", id_col))
    named = own.groupBy("component").agg(group_id(F.min(id_col)).alias("group"))
    return own.join(named, "component").select(id_col, "group")


def assign_splits(
    members: DataFrame,
    mode: str = "hash",
    seed: str = "42",
    dev_fraction: float = 0.1,
    retro: tuple[float, float, float] = (0.7, 0.1, 0.2),
    markov: tuple[float, float, float] = (0.8, 0.1, 0.1),
) -> DataFrame:
    """Adds ``split``; members has window_id, group, chrom ('' if none), holdout, dev_chrom, source.

    A group whose windows lie on chromosomes (holdout ones don't count) is train or dev, by
    hash or by chromosome; any other goes by the fractions of its kind.  Holdout windows are
    test; by chromosome, a window's own one decides.
    """
    genomic = (F.col("chrom") != "") & ~F.col("holdout")
    flags = members.groupBy("group").agg(F.bool_or(genomic).alias("genomic"), F.bool_or(genomic & ~F.col("dev_chrom")).alias("any_train"), F.bool_or(F.col("source") == "retrovirus").alias("retro"))
    u = hash_fraction(F.lit(seed), F.col("group"))
    of_genomic = F.when(u < dev_fraction, "dev").otherwise("train") if mode == "hash" else F.when(F.col("any_train"), "train").otherwise("dev")
    base = F.when(F.col("genomic"), of_genomic).when(F.col("retro"), by_fractions(u, SPLITS, retro)).otherwise(by_fractions(u, SPLITS, markov))
    out = members.join(flags.select("group", base.alias("base")), "group")
    split = F.when(F.col("holdout"), "test")
    if mode != "hash":
        split = split.when(F.col("chrom") != "", F.when(F.col("dev_chrom"), "dev").otherwise("train"))
    return out.withColumn("split", split.otherwise(F.col("base"))).drop("base")


def purge(split: DataFrame) -> DataFrame:
    """Without the windows outside test whose group has one in test."""
    touched = split.where("split = 'test'").select("group").distinct()
    return split.where("split = 'test'").unionByName(split.where("split <> 'test'").join(touched, "group", "left_anti"))


def strict(split: DataFrame) -> DataFrame:
    """Adds ``is_test_strict`` (no member of the group in train or dev) and ``is_dev_strict`` (none in train)."""
    has = split.groupBy("group").agg(F.bool_or(F.col("split") == "train").alias("__t"), F.bool_or(F.col("split") == "dev").alias("__d"))
    out = split.join(has, "group")
    return out.withColumns({"is_test_strict": (F.col("split") == "test") & ~F.col("__t") & ~F.col("__d"), "is_dev_strict": (F.col("split") == "dev") & ~F.col("__t")}).drop("__t", "__d")


def group_summary(split: DataFrame) -> DataFrame:
    """(group, n, n_sources, first_window), in any order; ``reports.largest_group`` has the largest one."""
    return split.groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.min("window_id").alias("first_window"))


SETS = ("train", "dev", "dev_strict", "test", "test_strict")


def leak_checks(rows: DataFrame, width: int, mode: str = "hash", purged: bool = False) -> DataFrame:
    """(check, violations, mandatory) on (dataset, window_id, group, chrom, holdout, dev_chrom, seq, label).

    Mandatory ones must be 0 before anything is written.  Train and dev may share a group
    where dev goes by chromosome, and test may share one with them unless groups of test
    were purged; both are counted all the same.  One pass: rows to windows, windows to
    groups, groups to one row.
    """
    within = lambda *names: F.col("dataset").isin(*names)
    place = F.create_map(*(x for i, s in enumerate(SETS) for x in (F.lit(s), F.lit(1 << i))))
    has = lambda column, *names: F.col(column).bitwiseAND(sum(1 << SETS.index(n) for n in names)) > 0
    genomic = F.col("chrom") != ""
    own = {
        "holdout_outside_test": within("train", "dev", "dev_strict") & F.col("holdout"),
        "genomic_not_holdout_in_test": within("test", "test_strict") & genomic & ~F.col("holdout"),
        "dev_chrom_outside_dev": within("train", "test", "test_strict") & F.col("dev_chrom"),
        "genomic_not_dev_chrom_in_dev": within("dev", "dev_strict") & genomic & ~F.col("dev_chrom") & F.lit(mode != "hash"),
        "invalid_sequence": (F.length("seq") != width) | (F.translate("seq", "ACGT", "") != ""),
        "invalid_label": ~F.col("label").isin(0, 1),
    }
    windows = rows.groupBy("window_id").agg(F.bit_or(place[F.col("dataset")]).alias("w"), F.collect_set("group").alias("groups"), F.count("*").alias("n"), F.countDistinct("dataset").alias("sets"), *(F.count_if(c).alias(k) for k, c in own.items()))
    of_window = {
        "window_in_train_and_other": has("w", "train") & has("w", "dev", "dev_strict", "test", "test_strict"),
        "window_in_dev_and_test": has("w", "dev", "dev_strict") & has("w", "test", "test_strict"),
        "repeated_in_a_set": F.col("n") > F.col("sets"),
    }
    windows = windows.select("w", "groups", *own, *(c.cast("long").alias(k) for k, c in of_window.items()))
    names = [*own, *of_window]
    # what is counted for a window goes with its first group
    spread = windows.select("w", F.posexplode_outer("groups").alias("at", "group"), *names)
    groups = spread.groupBy("group").agg(F.bit_or("w").alias("g"), *(F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, F.col(k)).otherwise(0)).alias(k) for k in names))
    of_group = {
        "group_in_train_and_dev": has("g", "train") & has("g", "dev"),
        "group_in_dev_strict_and_train": has("g", "dev_strict") & has("g", "train"),
        "group_in_test_strict_and_train_dev": has("g", "test_strict") & has("g", "train", "dev"),
        "group_in_test_and_train_dev": has("g", "test") & has("g", "train", "dev"),
    }
    one = groups.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names), *(F.count_if(c & F.col("group").isNotNull()).alias(k) for k, c in of_group.items()))
    optional = {"group_in_train_and_dev": mode == "hash", "group_in_test_and_train_dev": purged}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("violations"), F.lit(optional.get(k, True)).alias("mandatory")) for k in (*names, *of_group)))).alias("r")).select("r.*")


def failed_checks(checks: DataFrame) -> list[str]:
    """The mandatory checks that do not hold: a row per rule."""
    return [f"{r['check']} = {r['violations']}" for r in checks.where("mandatory AND violations > 0").orderBy("check").collect()]


def orientation_pairs(rows: DataFrame) -> DataFrame:
    """(window_id, dataset) that break the pair rule: exactly one fwd and one rc in each dataset, and datasets of one kind only."""
    per = rows.groupBy("window_id", "dataset").agg(F.sort_array(F.collect_list("orientation")).alias("o"))
    bad = per.where(F.col("o") != F.array(F.lit("fwd"), F.lit("rc"))).select("window_id", "dataset")
    sets = rows.groupBy("window_id").agg(F.collect_set("dataset").alias("d"))
    for kind in (("train",), DEV, TEST):
        sets = sets.where(F.size(F.array_except("d", F.array(*map(F.lit, kind)))) > 0)
    return bad.union(sets.select("window_id", F.lit("*").alias("dataset")))


def shared_sequences(train: DataFrame, test: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(sequence, rows): sequences of both sides, with (name, label) of every test row that has one, sorted; nulls match nothing.

    Only sequences that the training rows have, once each, meet the test rows.
    """
    hit = test.join(train.select(sequence).distinct(), sequence, "left_semi")
    return hit.groupBy(sequence).agg(F.array_sort(F.collect_list(F.struct("name", "label"))).alias("rows"))


def without_shared(train: DataFrame, test: DataFrame, sequence: str = "sequence") -> DataFrame:
    """The training rows whose sequence no test row has; a null sequence stays."""
    return train.join(test.select(sequence).distinct(), sequence, "left_anti")
