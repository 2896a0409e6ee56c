"""Counts of words against plain loops."""

import collections

from strandline.operators import features, markov


def test_counts_of_any_letters(spark):
    data = [(1, "ACGTACGT"), (1, "ACGNé"), (2, "AC"), (3, None), (4, ""), (5, "NNNNN")]
    df = spark.createDataFrame(data, "id long, seq string")
    want = collections.Counter((i, s[j : j + 3]) for i, s in data if s for j in range(len(s) - 2))
    found = features.kmer_counts(df, "id", "seq", 3)
    assert {(r["id"], r["kmer"]): r["n"] for r in found.collect()} == want
    runs = markov.run_counts(df, 3)
    assert {r["run"]: r["n"] for r in runs.collect()} == collections.Counter(w for (_, w), n in want.items() for _ in range(n))
    # words are counted in the batches: no row for each place
    assert all("transform(sequence" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (found, runs))
