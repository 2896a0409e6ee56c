"""The operators against brute force, round trips and held-out accuracy, on small and awkward tables."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import audio, contamination, jaccard, languages, lines, packing, quality, records, secrets, shared, shingles, suffixes, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, bitmap string, n_lines string"
WORDS = ["alpha", "beta", "gamma", "delta", "Über", "été", "naïve", "x1", "zeta", "eta", "theta", "iota", "kappa", "mu"]
LONG = "This license line is repeated across many documents of the corpus."


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared lines and passages, nulls, empty, odd and long texts."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randrange(999))]) for _ in range(k))
    texts = [say(rng.randrange(1, 120)) for _ in range(n)]
    passage = say(110)
    for i in range(0, n, 7):
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[1]] * 3 + [f"{say(20)}\n{LONG}\n  {LONG.upper()} \n{say(9)}" for _ in range(5)]
    texts += [say(15) + "\n" + passage + "\n" + say(15) for _ in range(4)]
    texts += ["", None, " \t\n\n", "one", "Two  words", "a\x00b", "tab\tand space", "<|endoftext|> x", "x" * 900, say(4000), "\n" * 30, "é" * 500]
    return [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (2, texts[2]), (3, "other text of the same id"), (None, None), (None, texts[4]), (None, passage)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "clash", "clash", "clash", "clash") for i, t in rows], DOCS).repartition(3)


def sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


# op1


def test_fingerprints_align(spark):
    rng = np.random.default_rng(1)
    tune = audio.played(rng.normal(0, 0.2, 160).tolist())
    other = audio.played(rng.normal(0, 0.2, 160).tolist())
    late = tune[10 * audio.HOP :]
    noisy = (tune + rng.normal(0, 150, len(tune))).astype("<i2")
    clips = [(0, tune), (1, late), (2, noisy), (3, other), (4, tune), (20, other), (5, tune[:100]), (6, None)]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c.astype("<i2").tobytes())) for i, c in clips], "id long, audio binary")
    df = df.select("id", audio.fingerprint(F.col("audio")).alias("prints"), F.lit("x").alias("key"))
    out = {r["id"]: r for r in audio.search(df, F.col("id") % 20 == 0).collect()}
    assert out[0]["class_id"] == out[4]["class_id"] == 0 and out[20]["class_id"] == 3 and out[5]["class_id"] is None
    assert out[0]["n_links"] == 3 and out[0]["best_error"] <= 0.08 and out[20]["n_links"] == 1
    assert out[1]["n_links"] is None and len(out) == len(clips)
    q = audio.postings([7], [audio.prints(tune)])
    _, offset, _, error = audio.align(audio.prints(late), q, 0.08, 16)
    assert offset.tolist() == [-10] and error[0] < 0.01
    assert audio.search(df.limit(0), F.lit(True)).count() == 0


def test_all_matches_come_out(spark):
    rng = np.random.default_rng(2)
    tune, other = (audio.played(rng.normal(0, 0.2, 160).tolist()) for _ in range(2))
    clips = [(0, tune), (1, tune[10 * audio.HOP :]), (2, tune[20 * audio.HOP :]), (4, tune), (20, other), (21, other), (40, tune[10 * audio.HOP :]), (60, tune), (80, other), (80, other)]
    df = spark.createDataFrame([(i, audio.prints(c).view(np.int32).tolist()) for i, c in clips], "id long, prints array<int>")
    pairs = audio.match_pairs(df, F.col("id") % 20 == 0).collect()
    assert sorted((r["query_class"], r["class_id"], r["members"], r["offset"]) for r in pairs) == [(0, 0, 3, 0), (0, 1, 2, -10), (0, 2, 1, -20), (1, 0, 3, 10), (1, 1, 2, 0), (1, 2, 1, -10), (20, 20, 4, 0)]
    out = {r["id"]: r for r in audio.search(df, F.col("id") % 20 == 0).collect()}
    assert {i: (r["n_links"], r["best_id"], r["best_offset"], r["best_error"]) for i, r in out.items() if r["is_query"]} == {0: (5, 4, 0, 0), 20: (3, 21, 0, 0), 40: (5, 1, 0, 0), 60: (5, 0, 0, 0), 80: (3, 20, 0, 0)}
    assert audio.match_pairs(df.limit(0), F.lit(True)).count() == 0


def test_bit_errors_by_hand():
    a = np.arange(40, dtype=np.uint32) * 2654435761
    b = a.copy()
    b[3] ^= 0b111
    _, offset, votes, error = audio.align(b, audio.postings([0], [a]), 1.0, 1)
    # a print has a vote for each mask: the changed one is equal where its lowest byte doesn't count
    assert (offset[0], votes[0], error[0]) == (0, 4 * 39 + 1, 3 / (32 * 40))


def test_recall_at_the_promised_error():
    """Random prints with 8 % of their bits turned, in recordings of 16 prints and more, against all pairs."""
    rng = np.random.default_rng(4)
    for n in (16, 24, 40):
        found = within = 0
        q = audio.postings(list(range(200)), own := [rng.integers(0, 1 << 32, n, dtype=np.uint32) for _ in range(200)])
        for i, p in enumerate(own):
            turned = np.packbits(rng.random((n, 32)) < 0.07, axis=1).view(np.uint32).ravel()
            other = np.concatenate([rng.integers(0, 1 << 32, 5, dtype=np.uint32), p ^ turned])
            if np.bitwise_count(turned).sum() > 0.08 * 32 * n:
                continue
            within += 1
            query, offset, _, _ = audio.align(other, q, 0.08, 16)
            found += (i, 5) in zip(query.tolist(), offset.tolist(), strict=True)
        assert found >= 0.97 * within > 100


def test_silence_is_counted_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    a = np.concatenate([np.zeros(60, np.uint32), rng.integers(0, 1 << 32, 30, dtype=np.uint32), np.zeros(40, np.uint32)])
    q = audio.postings([3, 4], [a[20:], a])
    whole = [x.tolist() for x in audio.align(a, q, 0.08, 16)]
    monkeypatch.setattr(audio, "PAIRS", 37)
    assert [x.tolist() for x in audio.align(a, q, 0.08, 16)] == whole and whole[:2] == [[0, 1], [20, 0]]


# op2 and op5


@pytest.mark.parametrize(("name", "mode"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", None)])
def test_encoder_gives_the_library_s_ids(rows, name, mode):
    e = tokens.Encoder(tokens.vocabulary(name), mode)
    odd = ["a  b", " a", "a ", "\n\n\nx", "x \n y", "x\t\ny", "it's  I'm", "word.\nThe, (x) don't!", "a\n\tb", "a\t\n\tb", "q́ ́", "\x02 \x02", "ΑΣ ΑΣ.", "İx", "..., --", "tail.\t", "a b  c"]
    texts = [t or "" for _, t in rows] + odd
    for part in (texts, texts[::-1], odd):
        for have, want in zip(e.encode(part), e.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert have.tolist() == want.ids
    column = pa.array([t for t in texts for _ in range(40)]).slice(7)  # slices of a column
    have = [x.tolist() for some in shared.blocks(column, 50) for x in e.encode(some)]
    assert have == [x.ids for x in e.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
    e._thin()
    assert [x.tolist() for x in e.encode(odd)] == [x.ids for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]


def ids_of(rows, name):
    t = tokens.Encoder(tokens.vocabulary(name)).tokenizer
    return [(i, np.array([*e.ids, 1], "<u4")) for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True)]


def test_packing(spark, rows):
    out = packing.pack(table(spark, rows), tokens.vocabulary("byte_bpe_50k.json"), "byte").toPandas()
    want = collections.Counter((-1 if i is None else i, len(x)) for i, x in ids_of(rows, "byte_bpe_50k.json"))
    assert collections.Counter(zip(out.doc_id.fillna(-1).astype(int), out.doc_tokens.where(out.start == 0), strict=True))[(0, want and next(n for (i, n) in want if i == 0))] == 1
    assert out.length.sum() == sum(n * c for (_, n), c in want.items())
    known = {i: x for i, x in ids_of(rows, "byte_bpe_50k.json") if i not in (2, 3, None)}
    for i, g in out[out.doc_id.isin(list(known))].sort_values("start").groupby("doc_id"):
        at = 0
        for p in g.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(known[int(i)][at : at + p.length].tobytes())
            at += p.length
        assert at == len(known[int(i)])
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert packing.pack(table(spark, []), tokens.vocabulary("byte_bpe_50k.json"), "byte").count() == 0


def test_placing_balances_and_pads_little():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 5000, 3000)
    rows = np.array(packing.place(n, 2048, 1.0, 1 / 2048))
    used = np.bincount(rows[:, 3], rows[:, 2])
    assert used.max() <= 2048 and 2048 * len(used) - used.sum() < 2048
    assert (np.bincount(rows[:, 0], rows[:, 2]) == n).all()
    whole = rows[rows[:, 2] == 2048]
    rest = np.bincount(rows[:, 3], packing.cost(rows[:, 2], 1.0, 1 / 2048))[len(np.unique(whole[:, 3])) :]
    assert rest.std() / rest.mean() < 0.35


def test_records(spark, rows, tmp_path):
    path = records.write_records(table(spark, rows), tokens.vocabulary("word_bpe_49k.json"), "word", path=str(tmp_path / "r"), file_records=9)
    assert len(list((tmp_path / "r" / "data").glob("part-*"))) > 8
    out = records.read_records(spark, path).orderBy("start").collect()
    want = ids_of(rows, "word_bpe_49k.json")
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in out) == collections.Counter((i, tuple(x.tolist())) for i, x in want)
    start = 0
    for r in out:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    digests = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in out]
    assert sorted(map(tuple, records.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == digests
    keys = [r["doc_id"] for r in out]
    assert keys == sorted(keys, key=lambda i: (i is not None, i or 0))
    index = spark.read.parquet(f"{path}/index")
    picks = index.withColumn("rank", F.xxhash64("doc_id", F.lit(5))).where("doc_id % 3 = 0")
    some = {r["doc_id"]: r["ids"] for r in records.read_picked(spark, path, picks).collect()}
    assert some and all(tuple(v) == tuple(x.tolist()) for i, x in want if (v := some.get(i)) is not None and i not in (2, 3))


def test_corrupt_records():
    data = records.frame(7, np.array([1, 2, 70000])) + records.frame(None, np.array([], np.int64))
    assert [(k, ids.tolist()) for _, _, k, ids in records.frames(data)] == [(7, [1, 2, 70000]), (None, [])]
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(records.CorruptRecord):
            list(records.frames(bytes(bad)))
    with pytest.raises(records.CorruptRecord):
        list(records.frames(data[:-3]))


# op3


def test_signatures_lose_no_link():
    rng, bands = random.Random(1), jaccard.Bands(75)
    hot = np.array(sorted(rng.getrandbits(64) for _ in range(300)), np.uint64)
    links = 0
    for t in range(3000):
        base = [rng.getrandbits(64) for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 10, 13, 14, 20, 27, 28, 60, 200]))]
        share = rng.random() if t % 2 else 0
        base = list(dict.fromkeys(int(rng.choice(hot)) if rng.random() < share else x for x in base))
        other = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 5))):
            if rng.random() < 0.5 and len(other) > 1:
                other.pop(rng.randrange(len(other)))
            else:
                other.append(rng.getrandbits(64))
        a, b = {*base}, {*other}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        linked = a != b and 100 * len(a & b) >= 75 * len(a | b)
        if linked:
            links += 1
            assert len(np.intersect1d(jaccard.signatures(x, bands, hot), jaccard.signatures(y, bands, hot)))
        p, q = (jaccard.rows_of([jaccard.sketch_of(s)]) for s in (x, y))
        least = jaccard.differences(p, q)
        assert least[0] <= len(a ^ b)
        assert not linked or jaccard.may_link(np.array([len(a)]), np.array([len(b)]), least, 75)[0]
    assert links > 1000


def test_jaccard(spark, rows):
    own = sets(rows)
    parent = list(range(len(own)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(own):
        for j, (_, b) in enumerate(own[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, s) in enumerate(own):
        r = root(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    want = collections.Counter((key, len(s), (key if not s else least.get(root(i)))) for i, (key, s) in enumerate(own))
    out = jaccard.jaccard_components(table(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_shingles_tell_words_apart(monkeypatch):
    assert len(shingles.shingle_set("a b c d e f")) == 2 and len(shingles.shingle_set("A b")) == 1
    assert shingles.shingle_set("a b")[0] == shingles.shingle_set(" A\tB\n")[0] != shingles.shingle_set("a b")[0]
    many = [f"w{i}" for i in range(3000)]
    assert len(shingles.shingle_set(" ".join(many))) == 2996
    texts = [" ".join(many), " " * 9 + "x" * 25 + "\t\n" + "Y" * 3, "z" * 40, "a" * 10 + " " * 10 + "b" * 10, " "]
    whole = [shingles.hashes(t) for t in texts]
    monkeypatch.setattr(shingles, "PART_BYTES", 10)
    assert all((shingles.hashes(t) == w).all() and len(shingles.hashes(t)) == len(w) for t, w in zip(texts, whole, strict=True))
    assert len(shingles.word_hashes("\x0b\x0c a\x1cb \x85 c")) == 3


def test_a_very_long_word_needs_little_memory():
    import tracemalloc

    text = "x" * (8 << 20) + " y"
    tracemalloc.start()
    shingles.shingle_set(text)
    assert tracemalloc.get_traced_memory()[1] < 5 * len(text)
    tracemalloc.stop()


# op4


def test_containment(spark, rows):
    items = [(0, rows[5][1]), (1, "one"), (2, " ".join((rows[8][1] or "").split(" ")[3:70])), (3, None), (4, ""), (5, "never seen words in any document at all here"), (None, rows[6][1]), (0, rows[5][1])]
    noisy = rows + [(900, "noise " * 2000 + (rows[5][1] or "") + " tail" * 3000), (901, " ".join((rows[5][1] or "").split(" ")[: -len((rows[5][1] or "").split(" ")) // 5]))]
    df = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = contamination.find_contained(table(spark, noisy), df).collect()
    want = collections.Counter()
    for key, a in sets(noisy):
        for item, b in sets(items):
            if b and 100 * len(a & b) >= 75 * len(b):
                want[(key, item, len(a & b), len(b))] += 1
    assert collections.Counter(tuple(r) for r in out) == want and want
    assert contamination.find_contained(table(spark, noisy), df.limit(0)).count() == 0
    assert contamination.find_contained(table(spark, []), df).count() == 0


# op6 and op8


def labelled(spark, n=900):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + rng.choice(["###", "!!", "|"]) for w in words), int(good)))
    docs = spark.createDataFrame([(i, t, "label") for i, t, _ in rows] + [(None, "x", ""), (n, None, ""), (n + 1, "", "")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (n + 7, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality(spark):
    rows, docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((out[i] >= 0.7) == bool(y) for i, y in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == len(rows) + 3
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, flipped)
    assert np.allclose(model.weights, again.weights) and np.allclose(model.levels, again.levels)  # held-out labels don't matter
    assert quality.fit(docs, labels.limit(0)) is None and docs.select(quality.score(F.col("text"), None).alias("s")).first()["s"] == 1
    knots, levels = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert levels.tolist() == [0.0, 0.5, 1.0] and np.allclose(knots, [0.1, 0.25, 0.4])


def test_kernel_approximation():
    rng = np.random.default_rng(3)
    m = quality.Model(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), rng.normal(size=(quality.STATISTICS, 4096)) / np.sqrt(quality.STATISTICS), rng.uniform(0, 2 * np.pi, 4096), np.zeros(4097), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(6, quality.STATISTICS)) * 0.7
    z = m.features(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality.STATISTICS))).max() < 0.06


def test_languages(spark):
    rng = random.Random(4)
    alphabet = {"aa": "aeiou rst", "bb": "bcdfg hkl", "cc": "äöüß enr"}
    rows = [(i, "".join(rng.choice(alphabet[k]) for _ in range(rng.randrange(20, 200))), k) for i, k in enumerate(rng.choice(list(alphabet)) for _ in range(600))]
    odd = [(700, None, "aa"), (701, "", "bb"), (702, "123 ... !!", "cc"), (703, "a" * 50, None), (None, "etaoin rst", "aa")]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    model = languages.fit(df)
    out = {r["doc_id"]: r["p"] for r in df.select("doc_id", languages.predict(F.col("text"), model).alias("p")).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i]["lang_pred"] == k for i, k in held) / len(held) > 0.97
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (700, 701, 702)) and out[703]["lang_pred"] in alphabet
    assert languages.fit(df.where("lang IS NULL")) is None
    assert df.select(languages.predict(F.col("text"), None)["lang_pred"].alias("p")).distinct().collect() == [("und",)]
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_ngrams_stay_within_their_text():
    texts = ["ab", "", "c", "abc", "x" * 5]
    together = collections.Counter()
    for spans, kinds in languages.buckets(texts):
        for x in kinds:
            together.update(x[x > 0].tolist())
    alone = collections.Counter()
    for t in texts:
        at, n = languages.counts(t)
        alone.update(dict(zip(at.tolist(), n.tolist(), strict=True)))
    assert together == alone and sum(alone.values()) == sum(max(len(t) - k, 0) for t in texts for k in range(3))


# op7


def brute_lines(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    ids = lambda i: -(2**63) if i is None else i
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(ids(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(held[key(x)]) < 3 or max(held[key(x)]) == ids(i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


def test_lines(spark, rows):
    many = rows + [(1000 + i, f"{'Ünïcode line of 20cp'}\n{LONG}\nown {i}") for i in range(40)] + [(5000, "\n".join([LONG] * 50))]
    out = lines.dedup_lines(table(spark, many)).collect()
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out) == brute_lines(many)
    assert out[0]["bitmap"] == "clash" and lines.dedup_lines(table(spark, [])).count() == 0
    bits = lines.keep_bitmaps(table(spark, many)).where("id = 1000").first()["bitmap"]
    assert np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little")[:3].tolist() == [0, 0, 1]


@pytest.mark.parametrize("cuts", [(), (1,), (3, 4, 5), (2, 6, 9), tuple(range(1, 13))])
def test_streams_may_be_cut_anywhere(cuts):
    import pyarrow as pa

    data = [(h, 0, d, 0, p, 9) for h, docs in ((1, (9, 8)), (2, (7, 6, 5, 4)), (3, (3,)), (4, (9, 5, 1))) for d in docs for p in range(1 + (d == 7))]
    data.sort(key=lambda r: (r[0], -r[2], r[4]))
    cuts = [c for c in cuts if 0 < c < len(data) and data[c][:3] != data[c - 1][:3]]  # a document's rows stay together
    dropped, edges, sums = set(), [], collections.defaultdict(lambda: [0, -1])
    for lo, hi in zip([0, *cuts], [*cuts, len(data)], strict=True):
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*data[lo:hi], strict=True)], names=list("abcdef"))
        for kind, h1, _, d, _, p, n in lines.stream(iter([batch]), 3):
            if kind == lines.DROP:
                dropped.add((h1, d, p))
            elif kind == lines.EDGE:
                edges.append((h1, d, p))
            else:
                sums[h1] = [sums[h1][0] + n, max(sums[h1][1], d)]
    dropped |= {(h, d, p) for h, d, p in edges if sums[h][0] >= 3 and d != sums[h][1]}
    assert dropped == {(h, d, p) for h, _, d, _, p, _ in data if h in (2, 4) and d != {2: 7, 4: 9}[h]}


# op9


def brute_repeats(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return collections.Counter(out)


@pytest.mark.parametrize(("length", "levels", "paired"), [(400, suffixes.LEVELS, 48), (60, (1 << 20, 1 << 20), 2), (60, (2, 1 << 20), 48), (60, (2, 3), 48), (40, (3, 6), 2)])
def test_repeats(spark, rows, length, levels, paired, monkeypatch):
    monkeypatch.setattr(suffixes, "PAIRED", paired)
    out = suffixes.remove_repeats(table(spark, rows), length, levels).collect()
    have = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out)
    assert have == brute_repeats(rows, length)
    assert suffixes.remove_repeats(table(spark, []), length).count() == 0


PERIODIC = [(0, "z" * 1_000_000), (1, "q" + "abc" * 300_000 + "w"), (2, "z" * 400), (3, "bca" * 200), (4, "z" * 399), (5, "x" * 300 + "z" * 403 + "y" * 300), (6, "".join(chr(97 + i % 7) for i in range(70_000)))]


def test_stretches_that_repeat_themselves(spark):
    """Runs of one character and of short periods of up to 1 MB: few anchors, and nothing but the stretch goes."""
    for _, text in PERIODIC[:2] + PERIODIC[6:]:
        data = np.frombuffer(text.encode(), np.uint8)
        at, h = suffixes.anchors(data, 400)
        assert suffixes.runs(data, at, h, 400).sum() < 1000 < len(at)
    began = time.time()
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remove_repeats(table(spark, PERIODIC)).collect()}
    assert time.time() - began < 60
    assert out == {0: (1_000_000, 1, b""), 1: (900_000, 1, b"qw"), 2: (400, 1, b""), 3: (600, 1, b""), 4: (0, 0, b"z" * 399), 5: (403, 1, b"x" * 300 + b"y" * 300), 6: (70_000, 1, b"")}


@pytest.mark.parametrize("seed", range(6))
def test_short_periods_equal_brute_force(spark, seed):
    """Texts of short periods whose ends and lengths vary, with the same stretches elsewhere."""
    rng = random.Random(seed)
    parts = [rng.choice(["a", "ab", "aab", "abcd", "ab" * 7 + "c"]) for _ in range(4)]
    rows = [(i, "".join((p * 200)[rng.randrange(5) :][: rng.choice([20, 39, 40, 41, 45, 90, 300])] + rng.choice(["", "#", f"<{i}>"]) for p in (rng.choice(parts) for _ in range(rng.randrange(1, 6))))) for i in range(30)]
    want = brute_repeats(rows, 40)
    out = suffixes.remove_repeats(table(spark, rows), 40).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out) == sorted(want)


def test_touching_intervals_are_one(spark):
    rng = np.random.default_rng(3)
    start = rng.integers(0, 900, 400)
    rows = [(int(rng.integers(3)), 7, int(a), int(a + rng.integers(1, 9))) for a in start]
    covered = collections.defaultdict(set)
    for i, _, a, b in rows:
        covered[i] |= {*range(a, b)}
    out = {r["i"]: np.frombuffer(r["s"], "<i8").reshape(-1, 2).tolist() for r in suffixes.merged_spans(spark.createDataFrame(rows, "id long, th long, start long, end long").repartition(5), "i", "t", "s").collect()}
    for i, spans in out.items():
        assert {x for a, b in spans for x in range(a, b)} == covered[i] and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert len(out) == 3


def test_groups_are_settled_alike():
    rng = random.Random(5)
    length = 40
    for _ in range(60):
        left, right = (["".join(rng.choice("ab") for _ in range(2)) * 10 for _ in range(3)] for _ in range(2))
        texts = [left[rng.randrange(3)][rng.randrange(20) :] + "=" * 20 + right[rng.randrange(3)][: rng.randrange(21)] for _ in range(30)]
        places = [t.index("=") for t in texts]
        entries = sorted((b"\0" + (t[p : p + length] + t[:p][::-1]).encode(), len(t[p : p + length])) for t, p in zip(texts, places, strict=True))
        found = []
        for paired in (100, 1):
            suffixes.PAIRED, kept = paired, suffixes.PAIRED
            groups = suffixes.Groups(np.array([n for _, n in entries]), np.zeros(len(entries), int), length)
            before = b""
            for i, (e, _) in enumerate(entries):
                groups.add(suffixes.common(before, e, 0), e, i)
                before = e
            groups.settle()
            suffixes.PAIRED = kept
            found.append(sorted(groups.spans))
        assert found[0] == found[1]
        want = []
        for i, (a, n) in enumerate(entries):
            fits = [d for d in range(21) if any(i != j and len(a) - 1 - n >= d <= len(b) - 1 - m and min(n, m) >= length - d and a[1 : 1 + length - d] == b[1 : 1 + length - d] and a[1 + n : 1 + n + d] == b[1 + m : 1 + m + d] for j, (b, m) in enumerate(entries))]
            want += [(i, min(fits), max(fits))] if fits else []
        assert found[0] == want


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(6)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 30))) for _ in range(7)]
    coded = []
    for r in runs:
        codes, rest = suffixes.front_coded(r)
        assert [s for _, s in suffixes.decoded(codes, rest)] == r
        coded.append((n, s, None) for n, s in suffixes.decoded(codes, rest))
    out = list(suffixes.LoserTree(coded))
    assert [s for _, s, _ in out] == sorted(x for r in runs for x in r)
    assert all(n == suffixes.common(a[1], b[1], 0) for a, b in zip(out, out[1:], strict=False) for n in [b[0]])


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(8)
    a, b, c = (rng.integers(0, 4, n).astype(np.uint8) for n in (300, 100, 200))
    x, y = np.concatenate([a, b, c]), np.concatenate([c, b, a])
    for length in (40, 100):
        p, q = suffixes.anchors(x, length), suffixes.anchors(y, length)
        assert any(300 <= i <= 400 - length // 2 and i - 100 in q[0] for i in p[0])


# op10


def brute_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(spark):
    key = "tG7x9LqP2vZ0aB4cD6eF8hJ1kM3n"
    texts = ["password = hunter22", 'Été "API_KEY": "' + "a" * 30, "token:ab secret=abcdef,passwd= token=abcdefgh", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "B" * 20, "f" * 24, "f" * 23, "é" + "0123456789abcdef" * 3, None, "", "toKen=abcdefgh", f"see {key} there", "password = token: abcdefgh", "x" * 5000]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(100 + i, f"Ünd {key[::-1]} here", f"s{i}") for i in range(4)] + [(None, "token=abcdef", None), (0, texts[0], "s0")]
    df = spark.createDataFrame([(i, t, o, "en", "clash") for i, t, o in rows], "doc_id long, text string, source string, lang string, spans string")
    out = secrets.find_secrets(df).collect()
    assert len(out) == len(rows)
    want = collections.Counter((i, hashlib.sha256(brute_spans(t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in out) == want
    by = {r["doc_id"]: r for r in out}
    assert by[12]["spans"] == f"opaque:4:{4 + len(key)}" and by[12]["n_live"] == 1  # one owner's
    assert by[100]["spans"] == "" and by[100]["n_copied"] == 1  # four owners have it
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_repositories_count_too(spark):
    keys = ["tG7x9LqP2vZ0aB4cD6eF8hJ1kM3n", "Zq8w7Er6Ty5Ui4Op3As2Df1Gh0Jk"]
    rows = [(i, f"see {keys[0]} there", "s0", f"l{i}") for i in range(4)] + [(10 + i, f"token=abcdef see {keys[1]}", "s0", f"l{i % 3}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    by = {r["doc_id"]: r for r in secrets.find_secrets(df).collect()}
    assert all(by[i]["spans"] == "" and by[i]["n_copied"] == 1 and (by[i]["n_owners"], by[i]["n_repositories"]) == ([1], [4]) for i in range(4))
    assert all(by[10 + i]["n_live"] == 2 and (by[10 + i]["n_owners"], by[10 + i]["n_repositories"]) == ([1, 1], [3, 3]) for i in range(6))
    assert secrets.find_secrets(df.select("doc_id", F.lit("none").alias("text"), "source", "lang")).first()["n_owners"] == []


# long texts and ties


def test_very_long_texts(spark):
    """Two copies of a text of 2 MB, and a word of 1 MB, go through every operator whole."""
    rng = random.Random(12)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(150_000)) + "\npassword: abcdef123\n" + "y" * 1_000_000
    rows = [(0, long), (1, long), (2, "z" * 1_000_000), (3, "short text")]
    df = table(spark, rows)
    n = len(long.encode())
    out = {r["doc_id"]: r for r in suffixes.remove_repeats(df).collect()}
    assert [(out[i]["n_removed"], out[i]["n_spans"]) for i in range(4)] == [(n, 1), (n, 1), (1_000_000, 1), (0, 0)]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    size = len(shingles.shingle_set(long))
    assert size > 140_000 and out == {0: (size, 0), 1: (size, 0), 2: (1, 2), 3: (1, 3)}
    item = spark.createDataFrame([(7, " ".join(long.split(" ")[70_000:70_040]))], "item_id long, text string")
    assert sorted(map(tuple, contamination.find_contained(df, item).collect())) == [(0, 7, 36, 36), (1, 7, 36, 36)]
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(df, min_docs=2).select("doc_id", "n_lines", "n_dropped").collect()}
    assert out == {0: (3, 2), 1: (3, 0), 2: (1, 0), 3: (1, 0)}  # the password's line has 19 characters, one too few for a key
    assert {r["doc_id"]: r["n_assign"] for r in secrets.find_secrets(df).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}
    rows = [(0, long[:400_000]), (1, "b" * 5_000)]
    want = {i: len(x) for i, x in ids_of(rows, "byte_bpe_50k.json")}
    packed = packing.pack(table(spark, rows), tokens.vocabulary("byte_bpe_50k.json"), "byte").collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == want and sum(r["length"] for r in packed) == sum(want.values())


def test_ties_have_one_result():
    n = np.full(40, 700)
    rows = packing.place(n, 2048, 1.0, 1 / 2048)
    assert rows == packing.place(n, 2048, 1.0, 1 / 2048) and [r[0] for r in rows[:3]] == [0, 1, 2]
    assert [r[3] for r in rows[:3]] == [0, 1, 2]  # of sequences of equal cost the first
    prints = np.array([5, 5, 5, 5], np.uint32)
    query, offset, _, _ = audio.align(np.array([5, 5, 5, 5, 5], np.uint32), audio.postings([1], [prints]), 0.0, 1)
    assert (query[0], offset[0]) == (0, 0)  # of offsets with equal votes the smallest
