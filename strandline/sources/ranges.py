"""Files read and written by byte ranges: indexed FASTA, block gzip, matrices of half floats, digests.

Tasks open files by Arrow's file systems, so a path may be local on a shared folder or in a
store that Arrow knows.  No task holds more than a part of bounded size of a file, whatever
the length of a record, a line or a row's file.
"""

from __future__ import annotations

import ast
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes that a task reads at a time, and that one range has.
PART, RANGE = 8 << 20, 64 << 20
CHUNK = 1 << 16
INDEX = "path string, name string, length long, offset long, line_bases long, line_width long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def size_of(path: str) -> int:
    at, name = opened(path)
    info = at.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def byte_ranges(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """(path, start, end) of ranges of files, a task for each some of them."""
    sizes = [(p, size_of(p)) for p in paths]
    rows = spark.createDataFrame([x for x in sizes if x[1]], "path string, size long")
    ranges = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long"))))
    n = sum(-(-x // size) for _, x in sizes)
    return ranges.select("path", "start", F.least(F.col("start") + size, "size").alias("end")).repartition(min(max(n, 1), 100_000), "path", "start")


# indexed FASTA


def header_places(handle, start: int, total: int) -> Iterator[int]:
    """Places of the line starts with ``>`` from ``start`` on."""
    if start:
        handle.seek(start - 1)
    before, at = handle.read(1) if start else b"\n", start
    while at < total:
        handle.seek(at)
        data = handle.read(min(PART, total - at))
        both = before + data
        i = both.find(b"\n>")
        while i >= 0:
            yield at + i
            i = both.find(b"\n>", i + 1)
        before, at = data[-1:], at + len(data)


def _line(handle, at: int, stop: int) -> tuple[bytes, bool]:
    """The line at a place, and whether a line end follows."""
    handle.seek(at)
    line = b""
    while at + len(line) < stop:
        line += handle.read(min(1 << 16, stop - at - len(line)))
        if b"\n" in line:
            return line.split(b"\n", 1)[0], True
    return line, False


def _entry(handle, at: int, stop: int) -> tuple[str, int, int, int, int]:
    """(name, length, offset, line_bases, line_width) of the record from ``at`` to ``stop``."""
    head, _ = _line(handle, at, stop)
    offset = min(at + len(head) + 1, stop)
    line, ended = _line(handle, offset, stop)
    width, bases = max(len(line) + ended, 1), max(len(line.rstrip(b"\r")), 1)
    handle.seek(max(offset, stop - 2))
    tail = handle.read(stop - max(offset, stop - 2))
    whole, rest = divmod(stop - offset - (len(tail) - len(tail.rstrip(b"\r\n"))), width)
    name = head[1:].split(None, 1)
    return name[0].decode("utf-8", "replace") if name and head[1:2].strip() else "", max(whole * bases + min(rest, bases), 0), offset, bases, width


def files_of(path: str) -> list[str]:
    """The file, or the files of a folder whose names begin with neither _ nor a dot."""
    at, name = opened(path)
    if at.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = [x.base_name for x in at.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name[0] not in "_."]
    return [f"{path.rstrip('/')}/{x}" for x in sorted(found)]


def fasta_index(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, name, length, offset, line_bases, line_width) of each record of a file or a folder, like the usual index of such files.

    Ranges of the files are read side by side.  All lines of a record but the last must be
    equally long; a record where that can't be is an error when it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, name = opened(file)
                total, out, held = size_of(file), [], None
                with at.open_input_file(name) as handle, at.open_input_file(name) as other:
                    for place in header_places(handle, start, total):
                        if held is not None:
                            out.append((file, *_entry(other, held, place)))
                        held = place if place < end else None
                        if held is None:
                            break
                    if held is not None:
                        out.append((file, *_entry(other, held, total)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=["path", "name", "length", "offset", "line_bases", "line_width"])

    return byte_ranges(spark, files_of(path), size).mapInArrow(run, INDEX)


def write_index(spark: SparkSession, path: str, to: str | None = None) -> str:
    """The index as Parquet beside the file, where ``read_chunks`` and ``fetch_ranges`` look for it."""
    to = to or f"{path}.index"
    fasta_index(spark, path).write.mode("overwrite").parquet(to)
    return to


def letters_of(handle, offset: int, bases: int, width: int, start: int, end: int, name: str) -> str:
    """The letters start to end of a record; anything but letters where they should be is an error."""
    first, last = offset + start // bases * width + start % bases, offset + (end - 1) // bases * width + (end - 1) % bases + 1
    handle.seek(first)
    raw = np.frombuffer(handle.read(last - first), np.uint8)
    between = (first - offset + np.arange(len(raw))) % width >= bases
    if len(raw) != last - first or not np.array_equal((raw == 10) | (raw == 13), between) or (raw == 62).any():
        raise ValueError(f"lines of {name} are not equally long")
    return raw[~between].tobytes().upper().decode("ascii")


class Piece(InputPartition):
    """Chunks of some records: (path, name, length, offset, bases, width, first chunk, chunk after the last)."""

    def __init__(self, records: list[tuple]) -> None:
        self.records = records


class FastaChunks(DataSource):
    """``spark.read.format("fasta_chunks").option("path", ...)``: (name, chunk, seq), ``size`` letters a chunk.

    Filters on ``name`` and ``chunk`` decide which bytes are read, where the session pushes
    filters to Python sources.  The index is that of ``write_index``.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_chunks"

    def schema(self) -> str:
        return "name string, chunk long, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("size", CHUNK))
        self.index = options.get("index", f"{self.path}.index")
        self.names: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("name",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            elif column == ("chunk",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        import pyarrow.parquet as pq

        at, name = opened(self.index)
        wanted = None if self.names is None else [("name", "in", sorted(self.names))]
        rows = pq.read_table(name, filesystem=at, filters=wanted).to_pylist() if self.names != set() else []
        out: list[list[tuple]] = [[]]
        left = step = max(PART // self.size, 1)
        for r in rows:
            lo, stop = self.low, min(-(-r["length"] // self.size), self.high)
            while lo < stop:
                n = min(left, stop - lo)
                out[-1].append((r["path"], r["name"], r["length"], r["offset"], r["line_bases"], r["line_width"], lo, lo + n))
                lo, left = lo + n, left - n
                if not left:
                    out.append([])
                    left = step
        return [Piece(x) for x in out if x] or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        for path, key, length, offset, bases, width, lo, hi in partition.records:
            at, name = opened(path)
            with at.open_input_file(name) as handle:
                for chunk in range(lo, hi):
                    start = chunk * self.size
                    seq = letters_of(handle, offset, bases, width, start, min(start + self.size, length), key)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([chunk], pa.int64()), pa.array([seq])], names=["name", "chunk", "seq"])


def read_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(name, chunk, seq) of an indexed file; no row holds more than ``size`` letters."""
    spark.dataSource.register(FastaChunks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("fasta_chunks").option("path", path).option("size", size).load()


def fetch_ranges(spark: SparkSession, path: str, ranges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The ranges (name, start, end; 0-based half-open) with ``seq``; short where the record ends, and empty beyond it.

    Tasks read the bytes of their ranges and no others.  A range of an unknown record, a null
    one and one that ends before it starts go.
    """
    index = spark.read.parquet(f"{path}.index") if index is None else index
    want = ranges.select("name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("start >= 0 AND end >= start").distinct()
    placed = want.join(index, "name").select("name", "start", "end", "length", "offset", "line_bases", "line_width", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = handle = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                seqs = []
                for key, start, end, length, offset, bases, width, own in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if own != file:
                        at, name = opened(own)
                        file, handle = own, at.open_input_file(name)
                    end = min(end, length)
                    seqs.append(letters_of(handle, offset, bases, width, start, end, key) if start < end else "")
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(seqs, pa.string())], names=["name", "start", "end", "seq"])

    return placed.repartition("name", F.floor(F.col("start") / PART)).sortWithinPartitions("path", "name", "start").mapInArrow(run, "name string, start long, end long, seq string")


# block gzip


def block_size(head: bytes) -> int | None:
    """The length of the block of gzip that begins here, from its extra field; None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 6 <= min(12 + extra, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def _block(handle, at: int, total: int) -> tuple[bytes, int]:
    """(bytes, place of the next block); a damaged block is an error."""
    handle.seek(at)
    size = block_size(head := handle.read(min(1 << 16, total - at)))
    if size is None or at + size > total:
        raise ValueError(f"no block at byte {at}")
    raw = head[:size] if size <= len(head) else head + handle.read(size - len(head))
    try:
        return zlib.decompress(raw, 31), at + size
    except zlib.error as e:
        raise ValueError(f"damaged block at byte {at}: {e}") from e


def first_block(handle, start: int, total: int) -> int:
    """The first place from ``start`` on where a block begins that another block, or the end, follows."""
    at = start
    while at < total:
        handle.seek(at)
        data = handle.read(min(1 << 17, total - at))
        i = data.find(b"\x1f\x8b\x08\x04")
        if i < 0:
            at += max(len(data) - 3, 1)
            continue
        handle.seek(at + i)
        size = block_size(handle.read(64))
        if size is not None:
            after = at + i + size
            handle.seek(min(after, total))
            if after == total or after < total and block_size(handle.read(64)) is not None:
                return at + i
        at += i + 1
    return total


def block_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``value``: the lines of a file of gzip blocks, which many tasks read side by side.

    A line belongs to the range in which the block lies that it begins in, and a task reads
    on as far as its last line goes.  A damaged block is an error.
    """
    total = size_of(path)

    def lines(handle, start: int, end: int) -> Iterator[list[bytes]]:
        place = first_block(handle, start, total)
        if start == 0 and place and total:
            raise ValueError("the file doesn't begin with a block")
        rest, skip = b"", start > 0  # the range before reads on to the first line end of this one
        while place < total and (place < end or not skip):
            own = place < end
            data, place = _block(handle, place, total)
            if own:
                found = (rest + data).split(b"\n")
                rest = found.pop()
                if found and skip:
                    skip = False
                    del found[0]
                yield found
            elif b"\n" in data:
                yield [rest + data.split(b"\n", 1)[0]]
                return
            else:
                rest += data
        if rest and not skip:
            yield [rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name = opened(path)
        with at.open_input_file(name) as handle:
            for batch in batches:
                for start, end in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    for some in lines(handle, start, end):
                        if some:
                            yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for x in some], pa.string())], names=["value"])

    return byte_ranges(spark, [path], size).mapInArrow(run, "value string")


# digests


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files of a file's, folder's or pattern's path, but those whose names begin with _ or a dot."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = [x for top in store.globStatus(at) or [] for x in (store.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return sorted(x.getPath().toString() for x in own if x.isFile() and x.getPath().getName()[0] not in "_.")


def digests(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of the files of the column ``path``, of any length: a task streams each in bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                at, name = opened(path)
                digest, n = hashlib.sha256(), 0
                with at.open_input_stream(name) as stream:
                    while data := stream.read(PART):
                        digest.update(data)
                        n += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "bytes", "sha256"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, bytes long, sha256 string")


# matrices of half floats


def _npy_header(rows: int, dims: int) -> bytes:
    text = f"{{'descr': '<f2', 'fortran_order': False, 'shape': ({rows}, {dims}), }}".encode()
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", 118) + text.ljust(117) + b"\n"


def write_matrix(rows: DataFrame, path: str, dims: int, row_col: str = "row_idx", vector_col: str = "embedding") -> int:
    """The vectors as one raw matrix of half floats in the order of their row numbers, which must be 0 to n - 1; returns n.

    Tasks write sorted stretches of rows to files of their own; a task that is repeated
    writes another file, and only what succeeded is named.  One task then joins the files,
    a part at a time.  A missing or repeated row, another length, and a number that is null,
    not finite or beyond half floats are errors, and no file appears.
    """
    spark, staging = rows.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    at, name = opened(staging)
    at.create_dir(name, recursive=True)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name = opened(staging)
        file, first, last = f"{name}/{uuid.uuid4().hex}", None, None
        with at.open_output_stream(file) as out:
            for batch in batches:
                idx = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = batch.column(1)
                if batch.column(0).null_count or vectors.null_count or set(np.diff(vectors.offsets.to_numpy())) - {dims} or vectors.flatten().null_count:
                    raise ValueError(f"rows need a number and {dims} entries each")
                if (np.diff(idx, prepend=idx[0] - 1 if last is None else last) != 1).any():
                    raise ValueError("row numbers are missing or repeated")
                with np.errstate(over="ignore"):
                    half = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f2")
                if not np.isfinite(half).all():
                    raise ValueError("a number is not finite as a half float")
                out.write(half.tobytes())
                first, last = int(idx[0]) if first is None else first, int(idx[-1])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([last + 1], pa.int64()), pa.array([file])], names=["first", "after", "file"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if [x[0] for x in found] != [0, *[x[1] for x in found[:-1]]] and found:
            raise ValueError("row numbers are missing or repeated")
        n = found[-1][1] if found else 0
        at, name = opened(path)
        whole = f"{name}.{uuid.uuid4().hex}"
        with at.open_output_stream(whole) as out:
            out.write(_npy_header(n, dims))
            for _, _, file in found:
                with at.open_input_stream(file) as stream:
                    while data := stream.read(PART):
                        out.write(data)
        at.move(whole, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    own = rows.select(F.col(row_col).cast("long").alias("row"), F.col(vector_col).cast("array<float>").alias("vector"))
    try:
        parts = own.repartitionByRange("row").sortWithinPartitions("row").mapInArrow(part, "first long, after long, file string")
        done = parts.repartition(1).sortWithinPartitions("first").mapInArrow(join, "n long").first()
        return done["n"] if done else [*join(iter([]))][0].column(0)[0].as_py()
    finally:
        at.delete_dir(name)


def matrix_shape(path: str) -> tuple[int, int, int]:
    """(rows, entries a row, place of the first) of a raw matrix of half floats; another kind or size is an error."""
    at, name = opened(path)
    with at.open_input_file(name) as handle:
        head = handle.read(10)
        if head[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no matrix file")
        n = struct.unpack_from("<H", head, 8)[0] if head[6] == 1 else struct.unpack("<I", head[8:10] + handle.read(2))[0]
        begin = (10 if head[6] == 1 else 12) + n
        kind = ast.literal_eval(handle.read(n).decode("latin1").strip())
    if kind["descr"] != "<f2" or kind["fortran_order"] or len(kind["shape"]) != 2:
        raise ValueError(f"{path} holds {kind}")
    rows, dims = kind["shape"]
    if size_of(path) != begin + rows * dims * 2:
        raise ValueError(f"{path} has another size than its shape says")
    return rows, dims, begin


def read_matrix(spark: SparkSession, path: str, first: int = 0, after: int | None = None) -> DataFrame:
    """(row_idx, embedding) of the rows ``first`` to ``after``; only their bytes are read."""
    n, dims, begin = matrix_shape(path)
    after = n if after is None else min(after, n)
    step = max(PART // max(2 * dims, 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, name = opened(path)
        with at.open_input_file(name) as handle:
            for batch in batches:
                for lo in batch.column(0).to_pylist():
                    hi = min(lo + step, after)
                    handle.seek(begin + lo * dims * 2)
                    flat = np.frombuffer(handle.read((hi - lo) * dims * 2), "<f2").astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims or 1, dtype=np.int32)), pa.array(flat))], names=["row_idx", "embedding"])

    starts = spark.range(first, max(after, first), step, max(-(-(after - first) // step), 1))
    return starts.mapInArrow(run, "row_idx long, embedding array<float>")
