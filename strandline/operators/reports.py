"""Figures about finished sets, as rows; ``metadata`` puts them into one document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import rounded
from strandline.functions.tokens import has_unknown
from strandline.sources.readers import CHROMOSOMES


def strict_loss(base: DataFrame, strict: DataFrame, source: str = "l1") -> DataFrame:
    """(subfamily, n, outside, fraction) of a source's windows that the strict set lacks; the row of all has a null subfamily.

    The total's ``outside`` is the difference of the two sets' sizes, as a strict set is
    balanced on its own and needn't be part of its base.
    """
    own = base.where(F.col("source") == source).select("window_id", "subfamily")
    kept = strict.where(F.col("source") == source).select("window_id").distinct()
    marked = own.join(kept.withColumn("__kept", F.lit(1)), "window_id", "left")
    by = marked.groupBy("subfamily").agg(F.count("*").alias("n"), F.count_if(F.col("__kept").isNull()).alias("outside")).withColumn("fraction", rounded(F.col("outside") / F.col("n")))
    total = own.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each
    return by.unionByName(total.select(F.lit(None).cast("string").alias("subfamily"), "n", (F.col("n") - F.col("kept")).alias("outside"), F.lit(None).cast("double").alias("fraction")))


def identity_against_strict(base: DataFrame, strict: DataFrame, source: str = "l1") -> DataFrame:
    """One row: the source's windows, those below an identity of 0.90, those of the strict set, and those below 0.90 with a local identity of 0.95 or more.

    Identities are compared as they are, not as they are written.
    """
    own = base.where(F.col("source") == source)
    low = F.col("max_id_train") < 0.90
    figures = own.agg(F.count("*").alias("n"), F.count_if(low).alias("below"), F.count_if(low & (F.col("max_id_train_local") >= 0.95)).alias("below_but_local"))
    return figures.crossJoin(strict.where(F.col("source") == source).agg(F.count("*").alias("n_strict")))  # one row each


def largest_group(members: DataFrame, source: str = "l1") -> DataFrame:
    """(group, windows, source, n, fraction): the largest group, of equal ones the smallest name, by source, and its share of ``source``."""
    sizes = members.groupBy("group", "source").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("windows"))
    top = groups.agg(F.min_by(F.struct("group", "windows"), F.struct(-F.col("windows"), F.col("group"))).alias("t")).select("t.*")
    whole = sizes.where(F.col("source") == source).agg(F.sum("n").alias("whole"))
    out = sizes.join(F.broadcast(top), "group").crossJoin(whole)  # one row each
    return out.select("group", "windows", "source", "n", F.when(F.col("source") == source, rounded(F.col("n") / F.col("whole"))).alias("fraction"))


def composition(rows: DataFrame, column: str, dataset: str = "dataset", source: str | None = None) -> DataFrame:
    """(dataset, column, n), of one source's rows if it is named."""
    own = rows if source is None else rows.where(F.col("source") == source)
    return own.groupBy(dataset, column).agg(F.count("*").alias("n"))


def chromosomes_of(rows: DataFrame, dataset: str = "dataset", order: tuple[str, ...] = CHROMOSOMES) -> DataFrame:
    """(dataset, chromosomes): those that occur, in the given order; others after them by name; an empty name is none."""
    known = F.array(*map(F.lit, order))
    place = lambda c: F.when(F.array_position(known, c) > 0, F.array_position(known, c)).otherwise(len(order) + 1)
    found = F.collect_set(F.when(F.col("chrom") != "", F.struct(place(F.col("chrom")).alias("at"), F.col("chrom").alias("chrom"))))
    return rows.groupBy(dataset).agg(F.transform(F.array_sort(found), lambda x: x["chrom"]).alias("chromosomes"))


def gc_balance(rows: DataFrame, width: int) -> DataFrame:
    """(dataset, positives, negatives, difference): mean GC in percent, to two places; the difference is of the rounded figures.

    A side without rows is null, and so is then the difference.
    """
    mean = lambda y: F.try_divide(100 * F.sum(F.when(F.col("label") == y, F.col("gc"))), F.count_if(F.col("label") == y) * width)
    sides = rows.groupBy("dataset").agg(mean(1).alias("p"), mean(0).alias("q"))
    out = sides.select("dataset", F.bround("p", 2).alias("positives"), F.bround("q", 2).alias("negatives"))
    return out.withColumn("difference", F.bround(F.col("negatives") - F.col("positives"), 2))


def sequence_statistics(rows: DataFrame, dataset: str = "dataset", seq: str = "sequence", label: str = "label") -> DataFrame:
    """(dataset, n, n_1, fraction_1, shortest, mean_length, longest, with_n, with_iupac); null sequences count to n only."""
    letters = F.translate(seq, "ACGT", "")
    n = F.length(seq)
    out = rows.groupBy(dataset).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == 1).alias("n_1"),
        F.min(n).cast("bigint").alias("shortest"),
        F.bround(F.avg(n), 1).alias("mean_length"),
        F.max(n).cast("bigint").alias("longest"),
        F.count_if(F.instr(letters, "N") > 0).alias("with_n"),
        F.count_if(F.translate(letters, "N", "") != "").alias("with_iupac"),
    )
    return out.withColumn("fraction_1", rounded(F.col("n_1") / F.col("n")))


def token_statistics(rows: DataFrame, tokens: str = "tokens", split: str = "split") -> DataFrame:
    """(split, mean_tokens, most_tokens, with_unknown)."""
    n = F.size(tokens)
    return rows.groupBy(split).agg(F.bround(F.avg(n), 1).alias("mean_tokens"), F.max(n).alias("most_tokens"), F.count_if(has_unknown(F.col(tokens))).alias("with_unknown"))


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(column, n): the n most frequent values, of equally frequent ones the smaller first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def diagnosis(rows: DataFrame, epochs: DataFrame, tokens: str = "tokens", seq: str = "sequence") -> DataFrame:
    """One row about a training run that failed: letters outside ACGTN, unknown tokens, balance, loss and best epoch.

    Epochs are (epoch, loss, f1); ``loss_trend`` compares the first with the last; the best
    epoch is the first of the highest f1.  Without epochs those three are null.
    """
    data = rows.agg(F.count_if(F.translate(seq, "ACGTN", "") != "").alias("foreign_letters"), F.count_if(has_unknown(F.col(tokens))).alias("with_unknown"), F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_1"))
    ends = epochs.agg(F.min_by("loss", "epoch").alias("a"), F.max_by("loss", "epoch").alias("b"), F.bool_or(F.isnan("loss")).alias("nan"), F.min_by("epoch", F.struct(-F.col("f1"), F.col("epoch"))).alias("best_epoch"))
    trend = F.when(F.col("nan"), "nan").when(F.col("b") < F.col("a"), "fell").when(F.col("a").isNotNull(), "did not fall")
    return data.crossJoin(ends.select(trend.alias("loss_trend"), "best_epoch"))  # one row each


def metadata(reports: dict[str, DataFrame], settings: dict) -> str:
    """A JSON document of the settings and of each report's rows, in the order of their first columns.

    Reports have a row per set, source or rule, so the driver holds few.
    """
    rows = lambda df: [json.loads(r["j"]) for r in df.orderBy(*(F.col(c).cast("string") for c in df.columns[:2])).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    return json.dumps({"settings": settings, **{name: rows(df) for name, df in reports.items()}}, sort_keys=True)


def printed(report: DataFrame, title: str, order: list[str], most: int = 1000) -> str:
    """A report's rows as a table of text, ordered; beyond ``most`` rows it says how many there are."""
    rows = [[("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in report.orderBy(*order).limit(most + 1).collect()]
    lines = [report.columns, *rows[:most]]
    widths = [max(len(line[i]) for line in lines) for i in range(len(report.columns))]
    text = [f"=== {title} ===", *("  ".join(cell.ljust(w) for cell, w in zip(line, widths, strict=True)).rstrip() for line in lines)]
    return "\n".join([*text, f"... {report.count()} rows"] if len(rows) > most else text)
