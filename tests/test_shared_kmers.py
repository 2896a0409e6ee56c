"""Pairs by shared k-mers against brute force: k-mers of few holders make pairs where they meet, common ones are rows."""

from __future__ import annotations

import itertools
import random

import pytest

from strandline.operators import similarity


def table(spark, prefix, n, seed, kind):
    rng = random.Random(seed)
    pool = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    weights = [1 if i else 60 for i in range(300)]
    sets = {i: sorted({*rng.choices(pool, weights, k=rng.randrange(0, 30)), *([pool[1], pool[2]] if i % 3 == 0 else [])}) for i in range(n)}
    sets[n] = sets[4]
    sets = {(f"{prefix}{i}" if kind == "string" else i): v for i, v in sets.items()}
    return sets, spark.createDataFrame(list(sets.items()), f"id {kind}, kmers array<long>").repartition(3)


def brute(a, b):
    shared = {(x, y): len(set(a[x]) & set(b[y])) for x in a for y in b}
    return sorted((x, y, n, len(a[x]), len(b[y])) for (x, y), n in shared.items() if n)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_all_pairs_that_share_a_kmer_are_found(spark, kind):
    a, left = table(spark, "é", 70, 1, kind)
    b, right = table(spark, "b", 50, 1, kind)
    assert max(sum(k in v for v in a.values()) for k in set(itertools.chain(*a.values()))) > similarity.LIGHT
    assert sorted(map(tuple, similarity.shared_kmers(left, right, 7).collect())) == brute(a, b)
    of = similarity.classes(left)
    first = {r["id"] for r in of.where("id = class").collect()}
    own = {k: v for k, v in a.items() if k in first}
    assert sorted(map(tuple, similarity.class_pairs(left, of, most_common=7).collect())) == brute(own, own)


def test_a_kmer_of_few_holders_is_no_row(spark, monkeypatch):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT", k=400)) for _ in range(20)]
    df = spark.createDataFrame([(i, s[: 400 - 3 * (i % 4)]) for i, s in enumerate(s for s in seqs for _ in range(4))], "id long, seq string")
    written, write, rows = [], similarity._written, []

    def kept(df):
        out = write(df)
        written.append(df.columns)
        if "kmer" in df.columns:
            rows.append(out.where("kmer IS NOT NULL").count())
        return out

    monkeypatch.setattr(similarity, "_written", kept)
    found = similarity.cluster_pairs(df, "id")
    assert sorted(map(tuple, found.collect())) == sorted((4 * g + x, 4 * g + y) for g in range(20) for x, y in itertools.combinations(range(4), 2))
    assert rows and not any(rows)
