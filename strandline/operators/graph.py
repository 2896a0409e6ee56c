"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/components/{uuid.uuid4().hex}"


#: Bytes of edges that a task contracts, and nodes that it holds before it hands their edges on.
CONTRACT_BYTES, CONTRACT_NODES = 8 << 20, 1_000_000


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _contracted(edges: DataFrame, held: int) -> DataFrame:
    """(u, v): a forest that connects what each task's edges (u, v) connect, v being the smallest node that the task knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        kind = None

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        def told() -> pa.RecordBatch:
            found = [(x, r) for x in parent if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], kind) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= held:
                yield told()
                parent.clear()
        if parent:
            yield told()

    kind = edges.schema["u"].dataType.simpleString()
    size = int(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return edges.coalesce(max(1, -(-size // CONTRACT_BYTES))).mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, held: int = CONTRACT_NODES) -> DataFrame:
    """(node, component) of every node of an undirected edge table; the component is its smallest node.

    Each task contracts its edges to a forest first.  A round then costs two aggregations
    with map-side minima and two joins; the number of rounds grows with the logarithm of a
    component's size, not with its diameter.  Every round's edges are written to the
    shared folder, which cuts the lineage.  Self-loops keep their node; rows with a null
    end are passed over; repeated edges are one; no edges give no rows.
    """
    spark, root = edges.sparkSession, _folder(edges)
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both.write.parquet(f"{root}/edges")
    first = spark.read.schema(both.schema).parquet(f"{root}/edges")
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    _contracted(first, held).write.parquet(f"{root}/0")
    now = spark.read.schema(both.schema).parquet(f"{root}/0")
    sums = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(*sums).first()
    for n in range(1, max_rounds + 1):
        if not before[0]:
            break
        pairs = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small.write.parquet(f"{root}/{n}")
        now = spark.read.schema(both.schema).parquet(f"{root}/{n}")
        seen = now.agg(*sums).first()
        _remove(spark, f"{root}/{n - 1}")  # nothing reads it any more
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    label = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(label, nodes["node"] == label["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
