"""Column functions on sequences, positions and figures; all of them stay within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IUPAC = "RYKMSWBDHV"
BANDS = ("<0.80", "0.80-0.90", "0.90-0.95", ">=0.95")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def gc_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "GC", ""))


def gc_bin(gc: Column, length: Column, bins: int = 50) -> Column:
    return F.least(F.floor(gc * bins / length), F.lit(bins - 1)).cast("int")


def only_acgt(seq: Column) -> Column:
    """True for the empty sequence too."""
    return F.translate(seq, "ACGT", "") == ""


def discard_reason(seq: Column) -> Column:
    """Null for a clean sequence, else whether it has an N or only other letters."""
    return F.when(only_acgt(seq), None).when(F.instr(seq, "N") > 0, "with_n").otherwise("iupac")


def normalized(seq: Column) -> Column:
    """Stripped, in upper case, other IUPAC letters as N; null where a letter is none of these."""
    up = F.upper(F.regexp_replace(seq, r"^\s+|\s+$", ""))
    return F.when(F.translate(up, "ACGTN" + IUPAC, "") == "", F.translate(up, IUPAC, "N" * len(IUPAC)))


def kmers(seq: Column, k: int) -> Column:
    """All runs of k letters in order; an empty array for a shorter sequence."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def hash_fraction(*labels: Column) -> Column:
    """60 bits of the sha256 of the labels, joined by colons, as a fraction of one."""
    text = F.concat_ws(":", *labels)
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint") / F.lit(16.0**15)


def seed64(*labels: Column) -> Column:
    """64 bits of the sha256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *labels).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def by_fractions(u: Column, names: tuple[str, ...], fractions: tuple[float, ...]) -> Column:
    """The name into whose share of [0, 1) u falls; the last one takes the rest."""
    out, total = None, 0.0
    for name, share in zip(names[:-1], fractions[:-1], strict=True):
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def window_starts(a: Column, b: Column, width: int, stride: int, limit: Column) -> Column:
    """Starts of windows over [a, b): at the stride, with one flush right; a short span has one about its centre.

    Empty where the sequence of length ``limit`` has no room for a window.
    """
    steps = F.when(b - a >= width, F.sequence(a, F.greatest(b - width, a), F.lit(stride).cast("bigint")))
    tiled = F.array_distinct(F.concat(steps, F.array(b - width)))
    centred = F.array(centred_start(a, b, width, limit))
    return F.when(limit < width, F.array().cast("array<bigint>")).when(b - a >= width, tiled).otherwise(centred)


def centred_start(a: Column, b: Column, width: int, limit: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.floor((a + b) / 2) - width // 2, limit - width))


def gap_starts(a: Column, b: Column, width: int) -> Column:
    """Starts of windows side by side within a gap."""
    return F.when(b - a >= width, F.sequence(a, F.greatest(b - width, a), F.lit(width).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def identity_band(identity: Column) -> Column:
    return F.when(identity < 0.8, BANDS[0]).when(identity < 0.9, BANDS[1]).when(identity < 0.95, BANDS[2]).when(identity >= 0.95, BANDS[3])


def fixed(x: Column, places: int) -> Column:
    """A figure with so many places, ties to even on the double's own value; empty for null."""
    return F.coalesce(F.regexp_replace(F.format_number(x, places), ",", ""), F.lit(""))


def rounded(x: Column, places: int = 4) -> Column:
    return F.bround(x, places)


def coverage_class(covered: Column, least: int = 200) -> Column:
    return F.when(covered >= least, "positive").when(covered > 0, "grey").otherwise("none")


def package_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def accession(name: Column) -> Column:
    return F.split_part(name, F.lit(":"), F.lit(1))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))
