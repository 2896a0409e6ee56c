"""Registered queries on the smallest tables, and the pipeline stage by stage."""

import os
import re

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_all_are_registered():
    import __spark_entry__

    names = {*__spark_entry__.queries()}
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_partenum_jaccard", "op4_minhash_containment", "op7_line_bitmaps", "op9_suffix_merge", "op12_window_dedup", "op13_filter_audit"])
def test_equals_sql(spark, name):
    from strandline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    have, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    key = sorted(have.columns)
    assert sorted(map(tuple, have[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist()))


def test_pipeline(spark):
    import corpus_pipeline as p
    from strandline.llm.contamination import find_contained
    from strandline.llm.jaccard import jaccard_components
    from strandline.llm.shared import table

    docs = table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == columns and 0 < out.count() <= docs.count()
        if name == "line_bitmaps":
            assert out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0
        if name == "partenum_jaccard":
            assert jaccard_components(out).where("doc_id <> component_id").count() == 0
        if name == "minhash_containment":
            assert find_contained(out, table(spark, DATA, "benchmark")).count() == 0
        docs = out
    packed = p.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert p.ORACLE_SQL is None


def test_pipeline_judges_rows(spark):
    import corpus_pipeline as p
    from strandline.llm.shared import table

    item = table(spark, DATA, "benchmark").first()["text"]
    texts = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    rows = [(1, texts["a"]), (1, texts["b"]), (1, texts["b"]), (2, texts["a"]), (None, texts["a"]), (None, texts["c"]), (None, texts["c"]), (None, f"x {item}"), (3, f"y z {item}"), (3, texts["d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = [(1, texts["a"]), (1, texts["b"]), (None, texts["c"]), (3, texts["d"])]
    assert kept(p.drop_contaminated(spark, docs, DATA)) == sorted((r for r in rows if item not in r[1]), key=repr)
    assert kept(p.drop_contaminated(spark, p.keep_one_of_near(spark, docs, DATA), DATA)) == sorted(want, key=repr)


def one_of_near(rows, percent=75, k=5):
    """The first row, null ids last, of each group of rows whose shingle sets are linked; rows without words are alone, equal rows are one."""
    rows = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0], r[1] or ""))
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] not in group[:i]]


def test_stages_take_odd_tables(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names and no rows at all."""
    import corpus_pipeline as p
    from strandline.llm.shared import table

    item = table(spark, DATA, "benchmark").first()["text"]
    line = "a line that is held by more than three documents"
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, row_key string, id string, th string, kept string, component_id string, item_id string, score string"
    texts = [(1, None), (None, None), (2, ""), (2, ""), (3, "w " * 30_000), (4, f"{line}\nx"), (5, f"{line}\ny"), (6, f" {line.upper()} \nz"), (6, f" {line.upper()} \nz"), (7, f"{item} q"), (None, f"{item} r"), (8, "one"), (9, "one")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, *(f"{c}{k}" for c in "abcdefgh")) for k, (i, t) in enumerate(texts)], kind)
    found = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        found[name] = out.collect()
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert len(found["line_bitmaps"]) == len(texts)
    assert {r["n_lines"] for r in found["line_bitmaps"]} == {f"a{k}" for k in range(len(texts))}
    lines = {r["n_lines"]: r["text"] for r in found["line_bitmaps"]}
    assert (lines["a5"], lines["a6"], lines["a7"], lines["a0"]) == ("x", "y", f" {line.upper()} \nz", None)
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in found["partenum_jaccard"])
    assert kept == sorted((-1 if i is None else i, t or "") for i, t in one_of_near(texts))
    assert sorted(r["n_lines"] for r in found["minhash_containment"]) == sorted(f"a{k}" for k in range(len(texts)) if k not in (9, 10))
    packed = p.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("start = 0").count() == len(texts) and p.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0


@pytest.fixture(scope="module")
def documents():
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()


def test_registered_packing_and_records(spark, documents):
    import zlib

    import numpy as np
    from strandline.llm import queries, tokens

    ids = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = tokens.Encoder(tokens.vocabulary(name)).tokenizer
        ids[name] = {i: np.array([*e.ids, 1], "<u4") for (i, _), e in zip(documents, t.encode_batch([x or "" for _, x in documents], add_special_tokens=False), strict=True)}
    own = ids["byte_bpe_50k.json"]
    room = {}
    pieces = {}
    for r in queries.op2_cost_balanced_packing(spark, DATA).collect():
        assert r["doc_tokens"] == len(own[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(own[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of, total in ((pieces, {i: len(x) for i, x in own.items()}), (room, None)):
        for key, spans in of.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at
                at += n
            assert at == total[key] if total else at <= 2048
    own, start, want = ids["word_bpe_49k.json"], 0, []
    for i in sorted(own):
        want.append((i, start, len(own[i]), zlib.crc32(own[i].tobytes())))
        start += len(own[i])
    have = queries.op5_record_files(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, have)) == want


def test_registered_secrets(spark, documents):
    import hashlib
    import re

    from strandline.llm import queries

    from test_llm_operators import brute_spans

    for r in queries.op10_secret_ownership(spark, DATA).collect():
        base = brute_spans(dict(documents)[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert {*filter(None, base.split(","))} <= {*filter(None, r["spans"].split(","))}
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(re.findall(f"(?:^|,){k}:", base)) for k in ("assign", "access", "hex")]


def test_registered_classifiers(spark, documents):
    import zlib

    from strandline.llm import queries

    for name, columns in (("op6_quality_rff", {"score", "predicted"}), ("op8_language_ftrl", {"lang_pred", "score"})):
        out = queries.queries()[name](spark, DATA).collect()
        assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in documents) and {"doc_id", "held_out"} | columns <= {*out[0].asDict()}
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
        if name == "op6_quality_rff":
            assert all(r["predicted"] == (r["score"] >= 0.7) for r in out)
    truth = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_registered_audio(spark):
    """Classes, links and best matches of the search against all pairs of fingerprints."""
    import numpy as np
    from strandline.llm import audio, queries

    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall()
    own = {i: audio.prints(audio.played(v)) for i, v in rows}

    def near(a, b):
        best = None
        for o in range(-len(b) + 1, len(a)):
            lo, hi = max(o, 0), min(len(a), o + len(b))
            if hi - lo >= min(16, len(a), len(b)):
                e = np.bitwise_count(a[lo:hi] ^ b[lo - o : hi - o]).sum() / (32 * (hi - lo))
                best = e if best is None else min(best, e)
        return best is not None and best <= 0.08

    have = {r["vec_id"]: r["n_links"] for r in queries.op1_chroma_search(spark, DATA).collect() if r["is_query"]}
    asked = [i for i in own if i % 20 == 0]
    links = {i: sum(j != i and near(own[j], own[i]) for j in own) for i in asked}
    assert {*have} == {*asked} and sum(min(have[i], links[i]) for i in asked) >= 0.9 * sum(links.values())
    assert all(have[i] <= links[i] for i in asked)
