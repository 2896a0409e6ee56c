"""Sequences cut into words of six letters, as a fixed-vocabulary tokenizer of DNA does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special tokens and their numbers, single letters.
SPECIAL = {"<unk>": 0, "<pad>": 1, "<mask>": 2, "<cls>": 3, "<eos>": 4, "<bos>": 5}
LETTERS = "ATCGN"
WORD = 6


def vocabulary_size(word: int = WORD) -> int:
    """Special tokens, all words over ACGT, and the single letters."""
    return len(SPECIAL) + 4**word + len(LETTERS)


def words(seq: Column, word: int = WORD) -> Column:
    """Words side by side; what is left before an N or the end goes letter by letter, and the cut starts anew after an N.

    A run of other letters (lower case too) is one ``<unk>``.  Null gives null.
    """
    found = F.regexp_extract_all(seq, F.lit(f"([ACGT]{{{word}}}|[ACGTN]|[^ACGTN]+)"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.rlike("^[ACGTN]"), x).otherwise("<unk>"))


def with_start(tokens: Column) -> Column:
    return F.concat(F.array(F.lit("<cls>")), tokens)


def has_unknown(tokens: Column) -> Column:
    return F.array_contains(tokens, "<unk>")
