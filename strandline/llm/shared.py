"""What the operators of this package share: tables, the shared folder, words, null rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where rows must be told apart by a number.
NO_ID = -(2**63)
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/strandline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read from there: no task repeats what made them.

    The folder is added to ``paths``, for ``remove`` once nothing reads it any more.  What the
    writing job has shuffled is deleted when it ends, and not whenever the driver next
    collects garbage: nothing else reads it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # planned anew, so that the setting holds for it
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(df: DataFrame, mb: int = 32) -> int:
    """Shuffle partitions for all bytes of the files that a plan reads: as the session says, or more if a part would exceed ``mb``.

    Leaves whose size Spark doesn't know (it says exabytes) count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (mb << 20), 200_000))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), other columns dropped, so that no name can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


_LEAN = False


def lean() -> None:
    """From now on this worker gives large freed blocks back to the system: an executor's workers share its memory with the JVM."""
    global _LEAN
    if not _LEAN:
        _LEAN = True
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        except (AttributeError, OSError):  # another C library than glibc
            pass


def strings(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The values of a batch's column, of which Python holds a few at a time."""
    lean()
    for lo in range(0, len(column), step):
        yield from column.slice(lo, step).to_pylist()


def blocks(column: pa.Array, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.Array]:
    """Slices of a text column, nulls as empty texts: of bounded rows and bytes, or one text."""
    lean()
    column = column.fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield column.slice(lo, hi - lo)
        lo = hi


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
