"""Near pairs and best identities against brute force: chance pairs stay in their buckets, and a plain k-mer is dealt as four bytes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strandline.operators import similarity


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def families(seed, n=40):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("ACGT", k=rng.choice([60, 200, 400]))) for _ in range(8)] + ["AC" * 60, "A" * 80]
    out = []
    for i in range(n):
        s = rng.choice(bases)
        s = "".join(rng.choice("ACGTNn") if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else x for x in s)[rng.randrange(6) :]
        out.append((i, rc(s) if rng.random() < 0.3 else s))
    return out + [(n, out[3][1]), (n + 1, rc(out[3][1])), (n + 2, "ACGT"), (n + 3, ""), (n + 4, None), (n + 5, out[5][1]), (n + 5, out[6][1])]


def sets(rows):
    out = {}
    for i, s in rows:
        if s is not None:
            out.setdefault(i, set()).update(min(w, rc(w)) for w in (s[j : j + 16] for j in range(len(s) - 15)))
    return {i: x for i, x in out.items() if x}


@pytest.mark.parametrize("bucket", [40, 1000])
def test_near_pairs_are_those_of_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(similarity, "BUCKET", bucket)  # many buckets, so that bounds leave pairs open
    opened, shared_by = [], similarity.shared_by
    monkeypatch.setattr(similarity, "shared_by", lambda pairs, *rest: opened.append(pairs.count()) or shared_by(pairs, *rest))
    rows = families(1)
    own = sets(rows)
    want = set()
    for a in own:
        for b in own:
            less, more = sorted((len(own[a]), len(own[b])))
            if a < b and (len(own[a] & own[b]) / less) ** (1 / 16) >= 0.9 and less >= 0.8 * more:
                want.add((a, b))
    found = similarity.cluster_pairs(spark.createDataFrame(rows, "id long, seq string").repartition(3), "id").collect()
    assert len(found) == len(want) > 30 and {tuple(r) for r in found} == want
    assert len(opened) == 1 and (bucket == 40 or opened[0])


def test_best_identity_is_that_of_brute_force(spark):
    queries, targets = families(2, 25), families(3, 30) + [(100 + i, s) for i, s in families(2, 25)[:6]]
    a, b = sets(queries), sets(targets)
    want = {}
    for q in {i for i, _ in queries}:
        of = [(len(a[q] & x) / min(len(a[q]), len(x))) ** (1 / 16) for x in b.values() if q in a and min(len(a[q]), len(x)) >= 0.19 * max(len(a[q]), len(x))]
        want[q] = max(of, default=0.0) if max(of, default=0.0) >= 0.5 else 0.0
    q, t = (spark.createDataFrame(x, "id long, seq string") for x in (queries, targets))
    found = similarity.best_identity(q, t, "id").distinct().collect()
    assert {r["query"]: pytest.approx(r["max_id"]) for r in found} == want and len({*want.values()}) > 3


def test_chance_pairs_give_no_rows_and_kmers_are_four_bytes(spark):
    rng = np.random.default_rng(1)
    core = "".join(rng.choice(list("ACGT"), 17))  # each pair shares two k-mers, which no threshold asks for
    seqs = ["".join(rng.choice(list("ACGT"), 500)) + core[:: 1 if i % 2 else -1] for i in range(8)] + ["".join(rng.choice(list("ACGT"), 500)) for _ in range(400)]
    texts = spark.createDataFrame([(i, [s]) for i, s in enumerate(seqs)], "id long, seqs array<string>").repartition(2)
    rows = similarity.met(texts.selectExpr("0 AS side", "id", "seqs"), 4, False, 0.185)
    status = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    assert rows.count() == 0 and similarity.met(texts.selectExpr("0 AS side", "id", "seqs"), 4, False).count() > 0
    dealt = [x.shuffleWriteBytes() for x in map(stages().apply, range(stages().size())) if x.stageId() not in known]
    assert max(dealt) < 6 * sum(len(s) - 15 for s in seqs)
