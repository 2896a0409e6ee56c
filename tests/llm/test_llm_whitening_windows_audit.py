"""Whitening, repeated windows and the filter audit against brute force, on small and awkward tables."""

import collections
import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from strandline.llm import audit, whitening, windows

SPACE = r"[^\x20\x09-\x0D]+"
WORDS = ["alpha", "Beta", "gamma", "delta", "Über", "x#1", "eta", "GO"]

# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int").repartition(3)


def embeddings(n=120, d=20):
    rng = np.random.default_rng(5)
    mixed = rng.normal(0, 0.4, (n, d)) @ rng.normal(0, 1, (d, d))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(mixed)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(None, rows[4][1]), (7, rows[8][1])]
    return rows + [(2000, None), (2001, [None] * d), (2002, [float("nan")] + [0.0] * (d - 1)), (2003, [float("inf")] * d), (2004, [1.0] * (d - 1)), (2005, [])]


def test_whitening_equals_numpy(spark):
    rows = embeddings()
    out = whitening.by_component(whitening.whiten(vectors(spark, rows))).collect()
    usable = [(i, np.floor(np.array(v, float) * 64).astype(np.int64) + 1_000_000) for i, v in rows if v and len(v) == 20 and None not in v and np.isfinite(v).all()]
    fit = np.unique(np.array([x for _, x in usable]), axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(out) == 16 * len(usable) and {r["n"] for r in out} == {n} and {r["component"] for r in out} == {*range(1, 17)}
    want = collections.Counter((i, int(((n * x - total) ** 2).sum())) for i, x in usable)
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in out if r["component"] == 1) == want
    by = {i: x for i, x in usable if i is not None and i != 7}
    sign = {}
    for r in out:
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(e[k] / np.trace(v), rel=1e-9) and r["identity_error"] < 1e-9
        if r["vec_id"] in by:
            expected = (by[r["vec_id"]] - total / n) @ w[:, k] / math.sqrt(e[k])
            if abs(expected) > 1e-3:
                assert sign.setdefault(k, np.sign(expected * r["whitened"])) * r["whitened"] == pytest.approx(expected, rel=1e-7)
    mean = [sum(r["whitened"] for r in out if r["component"] == c and r["vec_id"] in {*range(120)} - {7}) for c in (1, 2)]
    assert all(math.isfinite(x) for x in mean)


def test_whitening_of_odd_tables(spark):
    schema = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [None])], [(1, [])]):
        out = whitening.by_component(whitening.whiten(vectors(spark, rows)))
        assert out.columns == schema and out.count() == 0
    one = whitening.by_component(whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).collect()
    assert [(r["deviation"], r["whitened"], r["identity_error"], r["n"]) for r in one] == [(0, None, None, 1)] * 4
    flat = whitening.by_component(whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])]))).collect()
    assert {r["whitened"] for r in flat if r["component"] == 2} == {None} and sorted(r["whitened"] for r in flat if r["component"] == 1) == [-1.0, 1.0]
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 0.5])])).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] < 3) and {r["n"] for r in huge} == {3}
    # no long holds 3 * x - S here, but Python's integers do
    far = float(1 << 54)
    exact = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors(spark, [(1, [far]), (2, [far])])).collect()}
    assert exact == {1: 0, 2: 0}


# repeated windows


def window_table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, kept string, spans string, id string").repartition(3)


def passages(seed=2, n=40):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(k))
    shared, rows = say(60), []
    for i in range(n):
        rows.append((i, say(rng.randrange(0, 40)) + rng.choice(["\n", "  ", "\t"]) + (shared if i % 4 == 0 else "") + " " + say(rng.randrange(30))))
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(200, "one two " * 60), (201, "z " * 300), (202, "one two " * 30)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, " ".join(["w"] * 19)), (304, " ".join(f"u{i}" for i in range(20))), (305, shared.lower())]
    return rows + [(5, rows[5][1]), (6, "another text of the id " + shared), (None, shared), (None, say(30))]


def brute_windows(rows, width):
    """Documents in the order of (id, hash of the text) are told apart by their text; each is judged once."""
    docs = sorted({(i, t) for i, t, _ in rows}, key=lambda d: (-(2**63) if d[0] is None else d[0], next(h for i, t, h in rows if (i, t) == d)))
    seen, out = set(), {}
    for i, t in docs:
        words = re.findall(SPACE, t or "")
        gone = set()
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if w in seen:
                gone.update(range(s, s + width))
            seen.add(w)
        out[i, t] = (len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone))
    return out


@pytest.mark.parametrize(("flush", "part", "width"), [(1 << 20, 1 << 17, 20), (300, 64, 20), (50, 7, 5)])
def test_windows(spark, monkeypatch, flush, part, width):
    from pyspark.sql import functions as F

    # workers import the module anew, so parts are cut in this process only
    rows = passages()
    df = window_table(spark, rows)
    hashed = [(r["doc_id"], r["text"], r["h"]) for r in df.withColumn("h", F.xxhash64("text")).collect()]
    want = brute_windows(hashed, width)
    out = windows.remove_windows(df, width).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"], r["text"]]
    monkeypatch.setattr(windows, "PART", part)
    text = rows[0][1] * 9
    h, g, n = windows.window_hashes(text, width)
    words = re.findall(SPACE, text)
    same = collections.defaultdict(set)
    for i in range(len(words) - width + 1):
        same[tuple(words[i : i + width])].add((int(h[i]), int(g[i])))
    assert n == len(words) and all(len(x) == 1 for x in same.values()) and len({*map(tuple, same.values())}) == len(same)


def test_places_and_runs():
    counts = np.array([3, 1, 2])
    starts = np.array([0, 5, 1_000_000, 70_000, 3, 65_538])
    assert windows._places(windows._deltas(starts, counts), counts).tolist() == starts.tolist()
    h, g = np.array([5, 5, 5, 2, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    order, runs = windows.equal_runs(h, g)
    assert [order[a:b].tolist() for a, b in zip(runs, [*runs[1:], 5], strict=True)] == [[3], [0, 2], [1, 4]]


def test_windows_of_odd_tables(spark):
    assert windows.remove_windows(window_table(spark, [])).count() == 0
    out = windows.remove_windows(window_table(spark, [(1, None), (None, None)])).collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in out] == [(0, 0, "")] * 2
    long = " ".join(f"w{i}" for i in range(200_000))
    out = {r["doc_id"]: r["n_removed"] for r in windows.remove_windows(window_table(spark, [(1, long), (2, long), (3, "q " * 300_000), (4, "y" * 1_000_000)])).collect()}
    assert out == {1: 0, 2: 200_000, 3: 299_999, 4: 0}


# filter audit


def brute_audit(docs, labels):
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        fails = {"A": len(w) < 50, "B": 100 * len({*w}) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        judged.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        mine, shapley = [j for j in judged if j[0] == part], collections.Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                fails = sum(f in j[1] for j in mine)
                shapley[f] += len(here)
                out[part, order, step] = [len(left), len(here), fails - len(here), sum(j[1] == {f} for j in mine), sum(j[2] for j in here), sum(j[3] for j in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit(spark):
    rng = random.Random(4)
    docs = []
    for i in range(150):
        t = " ".join(rng.choice(WORDS) + str(rng.randrange(rng.choice([3, 900]))) for _ in range(rng.choice([10, 49, 50, 80])))
        docs.append((i, t.lower() if rng.random() < 0.6 else t, f"s{i % 3}" if i % 10 else None))
    docs += [(200 + i, docs[0][1], "s0") for i in range(60)] + [(300, None, "s1"), (301, "", None), (302, " \n", "s9"), (0, docs[0][1], "s1"), (5, None, "s2"), (None, docs[0][1], "s1"), (None, "# A", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, source string, digest string, mask int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = audit.audit(df, marks).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COLUMNS] for r in out} == brute_audit(docs, labels) and len(out) == 600 * 5
    assert audit.audit(df.limit(0), marks).count() == 0
    none = audit.audit(df, marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum", "removed": "sum"}).first()
    assert none["sum(good_lost)"] == none["sum(toxic_lost)"] == 0 < none["sum(removed)"]


def test_many_parts_are_sent_in_time(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id AS doc_id", "'word' AS text", "concat('p', id) AS source")
    out = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = out.where("filter_order = 'ABCDE'").groupBy("step").agg({"part": "count", "removed": "sum"}).orderBy("step").collect()
    assert [(r["count(part)"], r["sum(removed)"]) for r in rows] == [(900, 900), *[(900, 0)] * 4]


def test_long_texts_are_audited_whole(spark):
    text = " ".join(f"w{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, text + " #", "s"), (4, "z" * 1_000_000, "s")], "doc_id long, text string, source string")
    row = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EDABC'").orderBy("step").collect()
    assert [r["removed"] for r in row] == [1, 1, 1, 0, 0] and hashlib.sha256(text.encode()).hexdigest()
