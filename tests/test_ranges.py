"""Files by byte ranges: indexed FASTA, gzip blocks, digests and matrices against plain reads."""

import gzip
import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import provenance
from strandline.sources import ranges, readers


def fasta(folder, seed=1):
    rng, records = random.Random(seed), {}
    for f in range(2):
        with open(f"{folder}/part-{f}.fa", "w", newline="") as out:
            for i in range(7):
                n, width, end = rng.choice([0, 1, 59, 60, 61, 1000, 5000]), rng.choice([60, 61, 7]), rng.choice(["\n", "\r\n"])
                seq = "".join(rng.choice("acgtACGTN") for _ in range(n))
                records[f"chr{f}.{i}"] = seq.upper()
                out.write(f">chr{f}.{i} a > comment|{i}{end}" + "".join(seq[j : j + width] + end for j in range(0, n, width)))
            out.write(">last\nACGT") if f else None
    records["last"] = "ACGT"
    return records


@pytest.fixture
def genome(tmp_path):
    folder = tmp_path / "fa"
    folder.mkdir()
    return str(folder), fasta(folder)


@pytest.mark.parametrize("size", [37, 1000, 1 << 20])
def test_index_and_fetch(spark, genome, size, tmp_path):
    path, records = genome
    index = ranges.fasta_index(spark, path, size).cache()
    found = {r["name"]: r["length"] for r in index.collect()}
    assert found == {k: len(v) for k, v in records.items()}
    rng = random.Random(size)
    want = [(k, a, a + rng.randrange(200)) for k, v in records.items() for a in (0, rng.randrange(len(v) + 3), max(len(v) - 5, 0))] + [("unknown", 0, 4), ("last", 3, 2), (None, 0, 1)]
    out = ranges.fetch_ranges(spark, path, spark.createDataFrame(want, "name string, start long, end long"), index).collect()
    assert {(r["name"], r["start"], r["end"]): r["seq"] for r in out} == {(k, a, b): records[k][a:b] for k, a, b in want if k in records and b >= a}


def test_chunks_are_pruned(spark, genome, monkeypatch):
    path, records = genome
    ranges.write_index(spark, path)
    df = ranges.read_chunks(spark, path, 100)
    rows = {(r["name"], r["chunk"]): r["seq"] for r in df.collect()}
    assert rows == {(k, i // 100): v[i : i + 100] for k, v in records.items() for i in range(0, len(v), 100)}
    long = max(records, key=lambda k: len(records[k]))
    some = df.where((F.col("name") == long) & (F.col("chunk") >= 3) & (F.col("chunk") < 5))
    assert [(r["chunk"], r["seq"]) for r in some.orderBy("chunk").collect()] == [(3, records[long][300:400]), (4, records[long][400:500])]
    reader = ranges.FastaReader({"path": path, "size": 100})
    left = list(reader.pushFilters([ranges.In(("name",), (long, "last")), ranges.GreaterThan(("chunk",), 2), ranges.EqualTo(("seq",), "A")]))
    assert [type(x) for x in left] == [ranges.EqualTo]
    read = [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for p in reader.partitions() for b in reader.read(p)]
    assert read == [(long, i) for i in range(3, -(-len(records[long]) // 100))]


def test_uneven_lines_are_an_error(spark, tmp_path):
    path = str(tmp_path / "x.fa")
    with open(path, "w") as f:
        f.write(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="equally long"):
        ranges.fetch_ranges(spark, path, spark.createDataFrame([("a", 0, 10)], "name string, start long, end long"), ranges.fasta_index(spark, path)).collect()


def blocks(data, size):
    """Gzip blocks with their lengths in an extra field, and the empty one at the end."""
    out = b""
    for part in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.mark.parametrize(("block", "size", "end"), [(50, 40, b"\n"), (50, 97, b""), (7, 300, b"\r\n"), (5000, 64, b"\n"), (64000, 1 << 20, b"\n")])
def test_blocks_are_read_side_by_side(spark, tmp_path, block, size, end):
    rng = random.Random(block)
    lines = [("".join(rng.choice("abcé\t") for _ in range(rng.choice([0, 3, 20, 400])))) for _ in range(120)] + ["last"]
    data = (b"\r\n" if end == b"\r\n" else b"\n").join(x.encode() for x in lines) + end
    path = str(tmp_path / "x.gz")
    with open(path, "wb") as f:
        f.write(blocks(data, block))
    assert gzip.open(path).read() == data
    df = ranges.block_lines(spark, path, size)
    assert sorted(r["value"] for r in df.collect()) == sorted(lines)
    assert df.rdd.getNumPartitions() == max(-(-os.path.getsize(path) // size), 1)


def test_damaged_blocks_are_an_error(spark, tmp_path):
    raw = bytearray(blocks(b"some line of text\n" * 400, 100))
    path = str(tmp_path / "x.gz")
    for at in (30, len(raw) // 2, len(raw) - 40):
        bad = bytearray(raw)
        bad[at] ^= 0xFF
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match="block"):
            ranges.block_lines(spark, path, 500).collect()


def test_repeats_from_blocks(spark, tmp_path):
    rows = [["0"] * 5 + [f"chr{i % 30}", str(i), str(i + 5), "0", "+", f"n{i}", ["LINE", "LTR?", "DNA", "Low_complexity"][i % 4], "L1", "0"] for i in range(500)]
    data = "\n".join("\t".join(r) for r in rows).encode() + b"\n"
    for name, raw in (("a.gz", blocks(data, 1000)), ("b.txt", data)):
        with open(tmp_path / name, "wb") as f:
            f.write(raw)
    a, b = readers.read_repeats(spark, str(tmp_path / "a.gz"), ("LINE", "DNA"), blocks=True), readers.read_repeats(spark, str(tmp_path / "b.txt"), ("LINE", "DNA"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.count() > 300


def test_digests_stream(spark, tmp_path):
    for name, n in (("a", 0), ("b", 10), ("c", 3 * ranges.PART + 7)):
        with open(tmp_path / name, "wb") as f:
            f.write(b"x" * n)
    out = {os.path.basename(r["path"]): (r["size"], r["sha256"]) for r in provenance.file_hashes(spark, str(tmp_path)).collect()}
    assert out == {k: (n, hashlib.sha256(b"x" * n).hexdigest()) for k, n in (("a", 0), ("b", 10), ("c", 3 * ranges.PART + 7))}


def test_matrix_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 3, (1003, 5)).astype(np.float32)
    path = str(tmp_path / "m.npy")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, embedding array<float>").repartition(7)
    assert ranges.write_matrix(df, path, 5) == 1003 and sorted(os.listdir(tmp_path)) == ["m.npy"]
    assert (np.load(path) == x.astype(np.float16)).all()
    out = ranges.read_matrix(spark, path, 100, 900).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in out] == [*range(100, 900)] and (np.array([r["embedding"] for r in out], np.float16) == x[100:900].astype(np.float16)).all()
    assert ranges.write_matrix(df.limit(0), str(tmp_path / "e.npy"), 5) == 0 and ranges.read_matrix(spark, str(tmp_path / "e.npy")).count() == 0
    for bad in ("row_idx + (row_idx > 7) AS row_idx", "row_idx - (row_idx > 7) AS row_idx"):
        with pytest.raises(Exception, match="missing or repeated"):
            ranges.write_matrix(df.selectExpr(bad.replace("(row_idx > 7)", "CAST(row_idx > 7 AS INT)"), "embedding"), str(tmp_path / "bad.npy"), 5)
    for bad, message in (("array(1e6F, 0F, 0F, 0F, 0F)", "half float"), ("array(1F)", "entries"), ("NULL", "entries"), ("array(1F, NULL, 0F, 0F, 0F)", "entries")):
        with pytest.raises(Exception, match=message):
            ranges.write_matrix(df.selectExpr("row_idx", f"IF(row_idx = 5, {bad}, embedding) AS embedding"), str(tmp_path / "bad.npy"), 5)
    assert not os.path.exists(tmp_path / "bad.npy") and not [x for x in os.listdir(tmp_path) if "parts" in x]
    with open(path, "ab") as f:
        f.write(b"\0\0")
    with pytest.raises(ValueError, match="another size"):
        ranges.read_matrix(spark, path)
