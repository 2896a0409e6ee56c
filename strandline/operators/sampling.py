"""Deterministic samples: rows are taken in the order of a hash of their id, within quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import hash_fraction


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads; leaves of unknown size (exabytes, Spark says) count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 60)


def histogram(df: DataFrame, role: str, bin_col: str, roles: tuple[str, ...] = ()) -> DataFrame:
    """(role, bin, frac): shares by bin; each of ``roles`` that has no rows takes the shares of all rows.

    A null bin counts to no histogram.  No rows give no rows, whatever the roles.
    """
    counts = df.where(F.col(bin_col).isNotNull()).groupBy(role, bin_col).agg(F.count("*").alias("n"))
    total = counts.groupBy(role).agg(F.sum("n").alias("total"))
    of = total.withColumnRenamed(role, "__role")
    out = counts.join(of, F.col(role).eqNullSafe(F.col("__role"))).select(role, bin_col, (F.col("n") / F.col("total")).alias("frac"))
    if not roles:
        return out
    named = df.sparkSession.createDataFrame([(r,) for r in roles], f"{role} {df.schema[role].dataType.simpleString()}")
    whole = counts.groupBy(bin_col).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # one row
    # each named role meets every bin; of those that have rows of their own nothing is taken
    lacking = named.join(of.select("__role"), F.col(role) == F.col("__role"), "left_anti")
    return out.unionByName(whole.select(bin_col, (F.col("n") / F.col("total")).alias("frac")).crossJoin(F.broadcast(lacking)).select(role, bin_col, "frac"))  # the named roles


def take_by_hash(df: DataFrame, keys: list[str], id_col: str, quota: DataFrame, seed: str = "42", salt: int | None = None) -> DataFrame:
    """The first ``quota`` rows of each key in hash order; quota has (keys, quota).

    The hash's range is cut into ``salt`` slices that are ranked on their own, so that a key
    with most of the rows isn't sorted in one task; what the slices before a row's hold is
    carried in.  Without ``salt`` there are as many as the input has blocks of 16 MB, and 64
    at least.
    """
    salt = salt or max(64, min(input_bytes(df) >> 24, 1 << 20))
    df = df.withColumn("__u", hash_fraction(F.lit(seed), F.col(id_col).cast("string"))).withColumn("__s", F.floor(F.col("__u") * salt))
    sizes = df.groupBy(*keys, "__s").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy("__u", id_col)) + F.col("__before")
    out = df.join(sizes, [*keys, "__s"]).join(quota, keys).where(F.col("__before") < F.col("quota"))
    return out.withColumn("__rank", rank).where(F.col("__rank") <= F.col("quota")).drop("__u", "__s", "__before", "__rank", "quota")


def quotas(hist: DataFrame, pool: DataFrame, bin_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(bin, quota) of n rows after a histogram, halves to even; and (bin, quota, available, deficit)."""
    quota = hist.select(bin_col, F.rint(F.col("frac") * n).cast("bigint").alias("quota")).where("quota > 0")
    have = pool.groupBy(bin_col).agg(F.count("*").alias("available"))
    report = quota.join(have, bin_col, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return quota, report.withColumn("deficit", F.greatest(F.col("quota") - F.col("available"), F.lit(0)))


def balance_targets(rows: DataFrame, group: list[str], mix: dict[str, float], filler: str, source: str = "source", label: str = "label") -> DataFrame:
    """(group, source, target, available, taken, deficit) of negatives for as many as there are positives.

    A source's target is its share of the positives, halves to even; the filler's is what is
    left; shortages of the others are filled from it.
    """
    others = [s for s in mix if s != filler]
    have = lambda s: F.count_if((F.col(label) == 0) & (F.col(source) == s))
    x = rows.groupBy(*group).agg(F.count_if(F.col(label) == 1).alias("n_pos"), *(have(s).alias(f"have_{s}") for s in mix))
    for s in others:
        x = x.withColumn(f"target_{s}", F.rint(F.col("n_pos") * mix[s]).cast("bigint"))
    x = x.withColumn(f"target_{filler}", F.greatest(F.col("n_pos") - sum((F.col(f"target_{s}") for s in others), F.lit(0)), F.lit(0)))
    missing = sum((F.greatest(F.col(f"target_{s}") - F.col(f"have_{s}"), F.lit(0)) for s in others), F.lit(0))
    row = lambda s: F.struct(
        F.lit(s).alias(source),
        F.col(f"target_{s}").alias("target"),
        F.col(f"have_{s}").alias("available"),
        F.least(F.col(f"target_{s}") + (missing if s == filler else F.lit(0)), F.col(f"have_{s}")).alias("taken"),
        F.greatest(F.col(f"target_{s}") - F.col(f"have_{s}"), F.lit(0)).alias("deficit"),
    )
    return x.select(*group, F.explode(F.array(*map(row, mix))).alias("r")).select(*group, "r.*")


def balanced(rows: DataFrame, group: list[str], mix: dict[str, float], filler: str, id_col: str, source: str = "source", label: str = "label", seed: str = "42") -> DataFrame:
    """All positives, and the negatives that the targets ask for."""
    targets = balance_targets(rows, group, mix, filler, source, label).select(*group, source, F.col("taken").alias("quota"))
    negatives = take_by_hash(rows.where(F.col(label) == 0), [*group, source], id_col, targets, seed)
    return rows.where(F.col(label) == 1).unionByName(negatives)


def evenly_spaced(df: DataFrame, row_idx: str, n: int, count: int) -> DataFrame:
    """``count`` rows spread over n, the first and the last among them; halves to even."""
    at = F.rint(F.col("id") * ((n - 1) / max(count - 1, 1))).cast("bigint")
    return df.join(df.sparkSession.range(min(count, n)).select(at.alias(row_idx)).distinct(), row_idx, "left_semi")


def dev_cut(rows: DataFrame, sequence: str, label: str, order: str, fraction: float, seed: str = "42") -> DataFrame:
    """Adds ``split``: of the distinct sequences of each class so large a share is dev, copies following; the first row's label is a sequence's class."""
    one = rows.groupBy(sequence).agg(F.min_by(label, order).alias("class"))
    sizes = one.groupBy("class").agg(F.rint(F.count("*") * fraction).cast("bigint").alias("quota"))
    dev = take_by_hash(one, ["class"], sequence, sizes, seed).select(sequence, F.lit("dev").alias("split"))
    return rows.join(dev, sequence, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def hash_ranks(df: DataFrame, id_col: str, seed: str = "42", slices: int = 64) -> DataFrame:
    """Adds ``rank``, from 0 on in the order of the id's hash: slices of its range are ranked on their own."""
    own = df.withColumn("__u", hash_fraction(F.lit(seed), F.col(id_col).cast("string"))).withColumn("__s", F.floor(F.col("__u") * slices))
    sizes = own.groupBy("__s").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    sizes = sizes.select("__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__s").orderBy("__u", id_col)) - 1 + F.col("__before")
    return own.join(F.broadcast(sizes), "__s").withColumn("rank", rank).drop("__u", "__s", "__before")  # a row a slice


def balanced_labels(df: DataFrame, id_col: str, seed: str = "42") -> DataFrame:
    """Adds ``label``: as many ones as zeros in hash order; of an odd number of rows the odd one is 0."""
    return hash_ranks(df, id_col, seed).withColumn("label", (F.col("rank") % 2).cast("int")).drop("rank")


def shuffled(df: DataFrame, id_col: str, epoch: Column | int) -> DataFrame:
    """Rows with ``position`` hash: an epoch's order."""
    return df.withColumn("position", hash_fraction((F.lit(epoch) if isinstance(epoch, int) else epoch).cast("string"), F.col(id_col).cast("string")))
