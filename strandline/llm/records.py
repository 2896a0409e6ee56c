"""Length-delimited binary records of token ids, with an offset index beside them.

A file is a run of frames.  A frame is, little-endian:

    u64  payload length
    u32  masked crc32 of these 8 bytes
    ...  payload: u8 bytes of a token id (2 or 4), plus 1 if the
               document's id is null; i64 that id; then the token ids
    u32  masked crc32 of the payload
    u8   0x0A

The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that checksums of
data that holds checksums don't cancel.  The final byte lets Spark's own text sink write
the files: any store that Spark writes to will do, and its commit protocol makes a lost
or repeated task harmless.  Files are in ascending order of (id, hash of the text), by
the numbers of the task and of the file within the task in their names; a file has a
bounded number of records.  ``index`` beside ``data`` is a table of (file, at, size,
doc_id, within, n_tokens, ids_crc32), by which records can be read in any order.  It is
made by reading the written files back, each checksum compared.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.shared import blocks, documents, partitions, shared_dir
from strandline.llm.tokens import encoder

HEAD, KEY, FOOT = struct.Struct("<QI"), struct.Struct("<Bq"), struct.Struct("<I")
#: Records of a file, so that a file is read by one task at any size of the input.
FILE_RECORDS = 20_000
#: Bytes of a frame besides its payload, with the final byte.
AROUND = HEAD.size + FOOT.size + 1


class CorruptRecord(ValueError):
    """A checksum or length doesn't fit the bytes."""


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = KEY.pack(width + (doc_id is None), doc_id or 0) + ids.astype(f"<u{width}", copy=False).tobytes()
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked(length)) + payload + FOOT.pack(masked(payload)) + b"\n"


def frames(data: bytes, verify: bool = True) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, size, document's id, token ids) of each record of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        if at + HEAD.size > len(view):
            raise CorruptRecord(f"cut off at byte {at}")
        n, crc = HEAD.unpack_from(view, at)
        if masked(view[at : at + 8]) != crc or at + n + AROUND > len(view):
            raise CorruptRecord(f"bad length at byte {at}")
        payload = view[at + HEAD.size : at + HEAD.size + n]
        if verify and (FOOT.unpack_from(view, at + HEAD.size + n)[0] != masked(payload) or view[at + n + AROUND - 1] != 10):
            raise CorruptRecord(f"bad payload at byte {at}")
        kind, key = KEY.unpack_from(payload)
        yield at, n + AROUND, None if kind & 1 else key, np.frombuffer(payload[KEY.size :], f"<u{kind & 6}")
        at += n + AROUND


def write_records(
    docs: DataFrame,
    vocabulary: str,
    mode: str | None = None,
    end_id: int = 1,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_records: int = FILE_RECORDS,
) -> str:
    """Encodes every text, writes data and index below ``path``, and returns it.

    A null text is empty, so that its record holds ``end_id`` alone; null ids come first.
    Rows with the same id are records of their own, in the order of their texts' hashes;
    equal rows are equal records.  No rows give no records.  Other columns are not looked
    at.  A text of any length is one record, which a task holds while it is made.
    """
    path = path or shared_dir(docs.sparkSession, "records")
    rows = documents(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(rows, 16), "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, mode)
        for batch in batches:
            lo = 0
            for texts in blocks(batch.column(1)):
                keys = batch.column(0).slice(lo, len(texts)).to_pylist()
                lo += len(texts)
                # the sink writes each frame's final byte
                out = [frame(k, np.append(ids, np.uint32(end_id)))[:-1] for k, ids in zip(keys, coder.encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    data = rows.select("doc_id", "text").mapInArrow(framed, "value binary").select(F.col("value").cast("string"))
    data.write.option("maxRecordsPerFile", file_records).text(f"{path}/data")
    index_records(docs.sparkSession, path).write.parquet(f"{path}/index")
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(name.alias("file"), "content")


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """The offset index: every file read back, every record checked."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(at, size, key, len(ids), zlib.crc32(ids.astype("<u4"))) for at, size, key, ids in frames(data.as_buffer())]
                at, size, key, n, crc = zip(*found, strict=True) if found else ((), (), (), (), ())
                within = np.cumsum(np.array(n, np.int64)) - np.array(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), *(pa.array(x, pa.int64()) for x in (at, size, key, within, n, crc))], names=["file", "at", "size", "doc_id", "within", "n_tokens", "ids_crc32"])

    return _files(spark, path).mapInArrow(walk, "file string, at long, size long, doc_id long, within long, n_tokens long, ids_crc32 long")


def _before(index: DataFrame) -> DataFrame:
    """(file, before): the number of ids in all files before it.  A row for each file is summed up."""
    order = [F.regexp_extract("file", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)")]
    total = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy(*order, "file").rowsBetween(Window.unboundedPreceding, -1))
    return total.select("file", F.coalesce(before, F.lit(0)).alias("before"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record as it was read back, ``start`` being the ids of all records before it."""
    index = spark.read.parquet(f"{path}/index")
    return index.join(_before(index), "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every record, checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                within = 0
                for _, _, key, ids in frames(data.as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((name, pa.string()), (key, pa.int64()), (within, pa.int64()), (len(ids), pa.int64()), (ids.astype(np.int64), pa.list_(pa.int64())))], names=["file", "doc_id", "within", "n_tokens", "ids"])
                    within += len(ids)

    rows = _files(spark, path).mapInArrow(read, "file string, doc_id long, within long, n_tokens long, ids array<long>")
    return rows.join(_before(spark.read.parquet(f"{path}/index")), "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def read_picked(spark: SparkSession, path: str, picks: DataFrame) -> DataFrame:
    """The records that ``picks``, rows of the index with a column ``rank``, name: (rank, doc_id, ids).

    Only the files that hold picked records are opened; a shuffled read is a ``rank`` by hash.
    """
    wanted = picks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "size", "rank"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(data.as_buffer())
                found = [(w["rank"], key, ids.astype(np.int64)) for w in wanted for _, _, key, ids in frames(view[w["at"] : w["at"] + w["size"]])]
                columns = list(zip(*found, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["rank", "doc_id", "ids"])

    return _files(spark, path).join(wanted, "file").select("content", "wanted").mapInArrow(cut, "rank long, doc_id long, ids array<long>")
