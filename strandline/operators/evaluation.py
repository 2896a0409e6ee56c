"""Classifier figures as plans: counts, ranks and running sums over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import BANDS, identity_band, rounded
from strandline.operators.scan import running_sums

SLICES = 1024


def _scores(df: DataFrame, keys: list[str], label: str, prob: str) -> DataFrame:
    """Per distinct score, descending: positives, negatives, and those up to and with it."""
    at = df.where(F.col(prob).isNotNull()).groupBy(*keys, prob).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    at = at.withColumn("__slice", F.floor(F.col(prob) * SLICES))
    return running_sums(at, keys, "__slice", [F.desc(prob)], {"tp": "pos", "fp": "neg"}, descending=True).drop("__slice")


def ranking(df: DataFrame, keys: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """(keys, auroc, auprc); null with a single class.  Equal scores count half, and are one step of the precision."""
    s = _scores(df, keys, label, prob)
    total = s.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.join(total, keys) if keys else s.crossJoin(total)  # one row
    better = F.col("fp") - F.col("neg") * 0.5
    out = s.groupBy(*keys, "p", "n").agg(F.sum(F.col("pos") * (F.col("n") - better)).alias("u"), F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(*keys, F.when(both, rounded(F.col("u") / (F.col("p") * F.col("n")))).alias("auroc"), F.when(both, rounded(F.col("ap"))).alias("auprc"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    d = [x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn)]
    under = F.sqrt(d[0]) * F.sqrt(d[1]) * F.sqrt(d[2]) * F.sqrt(d[3])
    return F.when(under == 0, 0.0).otherwise((tp.cast("double") * tn - fp.cast("double") * fn) / under)


def confusion(df: DataFrame, keys: list[str], predicted: Column, label: str = "label") -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*keys).agg(F.count_if(y & predicted).alias("tp"), F.count_if(~y & predicted).alias("fp"), F.count_if(y & ~predicted).alias("fn"), F.count_if(~y & ~predicted).alias("tn"))


def from_confusion(c: DataFrame, keys: list[str]) -> DataFrame:
    """n, n_pos, accuracy, macro_f1 (over the classes that occur) and mcc, rounded to four places."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1, f0 = _ratio(2.0 * tp, 2 * tp + fp + fn), _ratio(2.0 * tn, 2 * tn + fp + fn)
    has1, has0 = ((tp + fp + fn) > 0).cast("int"), ((tn + fp + fn) > 0).cast("int")
    n = tp + fp + fn + tn
    return c.select(*keys, n.alias("n"), (tp + fn).alias("n_pos"), rounded((tp + tn) / n).alias("accuracy"), rounded((f1 * has1 + f0 * has0) / (has1 + has0)).alias("macro_f1"), rounded(_mcc(tp, tn, fp, fn)).alias("mcc"))


def binary(df: DataFrame, keys: list[str], threshold: float | Column = 0.5, label: str = "label", prob: str = "prob") -> DataFrame:
    figures = from_confusion(confusion(df, keys, F.col(prob) >= threshold, label), keys)
    ranks = ranking(df, keys, label, prob)
    return figures.join(ranks, keys) if keys else figures.crossJoin(ranks)  # one row each


def best_threshold(df: DataFrame, keys: list[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """(keys, threshold, mcc): of the scores within 1e-12 of the best MCC the one nearest 0.5, of two the higher."""
    s = _scores(df, keys, label, prob)
    total = s.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    s = s.join(total, keys) if keys else s.crossJoin(total)  # one row
    s = s.withColumn("mcc", _mcc(F.col("tp"), F.col("n") - F.col("fp"), F.col("fp"), F.col("p") - F.col("tp")))
    top = s.groupBy(*keys).agg(F.max("mcc").alias("top"))
    s = (s.join(top, keys) if keys else s.crossJoin(top)).where("mcc >= top - 1e-12")  # one row
    first = F.min(F.struct(F.abs(F.col(prob) - 0.5).alias("far"), (-F.col(prob)).alias("minus"), F.col("mcc").alias("mcc"))).alias("b")
    return s.groupBy(*keys).agg(first).select(*keys, (-F.col("b.minus")).alias("threshold"), F.col("b.mcc").alias("mcc"))


def by_window(df: DataFrame, extra: list[str], row: str = "row_idx") -> DataFrame:
    """One row per window: the mean probability of its orientations; other columns from its first row.

    Conflicting labels of a window are an error.
    """
    agree = F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(F.raise_error(F.concat(F.lit("labels of a window differ: "), F.min("window_id").cast("string"))).cast("int"))
    return df.groupBy("window_id").agg(F.min(row).alias(row), agree.alias("label"), F.avg("prob").alias("prob"), *(F.min_by(c, row).alias(c) for c in extra))


def per_source(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Recall of a source's positives, or specificity of its negatives."""
    right = (F.col("prob") >= threshold).cast("int") == F.col("label")
    return df.groupBy("source", "label").agg(F.count("*").alias("n"), rounded(F.avg(right.cast("double"))).alias("rate")).withColumn("kind", F.when(F.col("label") == 1, "recall").otherwise("specificity"))


def target_against_negatives(df: DataFrame, target: str, threshold: float = 0.5) -> DataFrame:
    """Figures on the rows of one source and all negatives."""
    return binary(df.where((F.col("source") == target) | (F.col("label") == 0)), [], threshold)


def recall_by_band(df: DataFrame, target: str | None = None, threshold: float = 0.5, identity: str = "max_id_train") -> DataFrame:
    """(band, n, recall) of the target's positives; bands without rows have n 0; null identities are ``no_value``."""
    own = df.where("label = 1") if target is None else df.where((F.col("label") == 1) & (F.col("source") == target))
    found = own.groupBy(F.coalesce(identity_band(F.col(identity)), F.lit("no_value")).alias("band")).agg(F.count("*").alias("n"), rounded(F.avg((F.col("prob") >= threshold).cast("double"))).alias("recall"))
    bands = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, (*BANDS, "no_value")))).alias("band"))
    return bands.join(found, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), "recall")


def full_report(df: DataFrame, dev: DataFrame) -> DataFrame:
    """(level, at, threshold, figures): rows and windows, at 0.5 and at the threshold that is best on dev for the level."""
    out = None
    for level in ("row", "window"):
        own, tune = (x if level == "row" else by_window(x, []) for x in (df, dev))
        best = best_threshold(tune, []).select("threshold")
        for at in ("0.5", "dev"):
            t = best if at == "dev" else df.sparkSession.range(1).select(F.lit(0.5).alias("threshold"))
            scored = own.crossJoin(F.broadcast(t))  # one row
            part = binary(scored, ["threshold"], F.col("threshold")).withColumns({"level": F.lit(level), "at": F.lit(at)})
            out = part if out is None else out.unionByName(part)
    return out


def multiclass(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) of each class that occurs; 0 for 0/0."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    rows = cells.select(F.explode(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))).alias("r")).select("r.*")
    s = rows.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "hits")))
    p, r = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return s.withColumns({"precision": rounded(p), "recall": rounded(r), "f1": rounded(_ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted")))})


def multiclass_summary(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, precision, recall and F1 as means over the classes that occur, and MCC over all classes; 0 for 0/0."""
    s = multiclass(df, label, predicted)
    square = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    p, r = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted"))
    out = s.agg(F.sum("support").alias("n"), F.sum("hits").alias("c"), F.avg(p).alias("p"), F.avg(r).alias("r"), F.avg(f1).alias("f"), square("support", "predicted").alias("tp"), square("support", "support").alias("tt"), square("predicted", "predicted").alias("pp"))
    n = F.col("n").cast("double")
    under = F.sqrt(n * n - F.col("pp")) * F.sqrt(n * n - F.col("tt"))
    mcc = F.when(under == 0, 0.0).otherwise((F.col("c") * n - F.col("tp")) / under)
    return out.select("n", rounded(F.col("c") / n).alias("accuracy"), *(rounded(F.col(x)).alias(name) for x, name in (("p", "precision_macro"), ("r", "recall_macro"), ("f", "f1_macro"))), rounded(mcc).alias("mcc"))


def confusion_cells(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) for each pair of classes that occur, 0 among them; there are as many cells as classes squared."""
    cells = df.groupBy(F.col(label).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    classes = cells.select(F.explode(F.array("truth", "predicted")).alias("x")).distinct()
    all_of = classes.agg(F.collect_set("x").alias("xs"))  # a row of all classes
    grid = all_of.select(F.explode("xs").alias("truth"), "xs").select("truth", F.explode("xs").alias("predicted"))
    return grid.join(cells, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def verdict(value: Column, low: float = 0.90, high: float = 0.98) -> Column:
    return F.when(value.isNull(), "FAIL").when(value < low, "FAIL").when(value > high, "WARN").otherwise("PASS")
