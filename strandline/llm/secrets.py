"""Secret scan with corpus-wide ownership frequency.

A scan of each whole text finds the base kinds (assignments, access keys, long hex runs)
and further opaque tokens that look like credentials.  Of every candidate only a hash of
its value leaves the scan.  The hashes are counted over the corpus by distinct owners and
repositories: a value that many owners or many repositories have is an example that was
copied, any other is live-looking.  Opaque tokens become spans only if they are live-looking; base
spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import strings, written

# The patterns of the base kinds, and their order.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "opaque")

WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Access keys, long hex runs and opaque tokens all lie within runs of these bytes.
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
LONG_HEX = re.compile(rb"[0-9a-f]{24,}")
OPAQUE_BYTES, OPAQUE_BITS = 24, 3.5


def opaque(token: bytes) -> bool:
    """Long, with digits and letters of both cases, and of high entropy by byte."""
    if len(token) < OPAQUE_BYTES or not (re.search(rb"[0-9]", token) and re.search(rb"[a-z]", token) and re.search(rb"[A-Z]", token)):
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) >= OPAQUE_BITS


def scan(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, value) in code points, by start, then kind; a null text is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lower, found = data.lower(), []
    if any(w in lower for w in WORDS):
        found += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    for run in RUN.finditer(data):
        if b"AKIA" in run[0]:
            found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(data, *run.span()) if len(m[0]) >= 20]
        found += [(2, *m.span(), m[0]) for m in LONG_HEX.finditer(data, *run.span())]
        if opaque(run[0]) and not any(s < run.end() and run.start() < e for _, s, e, _ in found):
            found.append((3, *run.span(), run[0]))
    if len(data) != len(text or ""):
        at, points, where = 0, 0, {}
        for offset in sorted({x for _, s, e, _ in found for x in (s, e)}):
            points += len(data[at:offset].decode("utf-8", "surrogatepass"))
            at = offset
            where[offset] = points
        found = [(k, where[s], where[e], v) for k, s, e, v in found]
    return sorted(found, key=lambda x: (x[1], x[0]))


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_cols: tuple[str, ...] = ("source",),
    repository_cols: tuple[str, ...] = ("source", "lang"),
    copied_owners: int = 3,
    copied_repositories: int = 4,
) -> DataFrame:
    """One row per document: counts and digest of its base spans, all spans, and how many values are live-looking or copied.

    A null or empty text has no spans.  Rows with the same or a null id are documents of
    their own.  A null owner or repository counts as one owner or repository.  A value is
    copied if at least ``copied_owners`` owners or ``copied_repositories`` repositories have it;
    ``n_owners`` and ``n_repositories`` have the counts of each value of a document, opaque
    ones too, by start, then kind.  No rows give no rows.
    """
    key = lambda cols: F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key(owner_cols).alias("owner"), key(repository_cols).alias("repository"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])))
        for batch in batches:
            out = []
            for doc_id, owner, repository, text in zip(*map(strings, batch.columns), strict=True):
                found = [{"kind": k, "start": s, "end": e, "value": hashlib.blake2b(v, digest_size=16).hexdigest()} for k, s, e, v in scan(text)]
                out.append((row, doc_id, owner, repository, found))
                row += 1
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc_id", "owner", "repository", "found"])

    scanned = written(rows.mapInArrow(run, "row long, doc_id long, owner string, repository string, found array<struct<kind:int,start:long,end:long,value:string>>"), "secrets")
    found = scanned.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    by_owner = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.count("*").alias("r"))
    owners = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))
    judged = (
        found.select("row", "kind", "start", "end", "value")
        .join(owners.withColumn("copied", (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)), "value")
        .groupBy("row")
        .agg(
            F.count_if("copied").alias("n_copied"),
            F.count_if(~F.col("copied")).alias("n_live"),
            F.collect_list(F.when((F.col("kind") == 3) & ~F.col("copied"), F.struct("kind", "start", "end"))).alias("more"),
            F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repositories"))).alias("held"),
        )
    )
    base = F.filter("found", lambda x: x["kind"] < 3)
    spell = lambda x: F.array_join(F.transform(x, lambda y: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), y["kind"] + 1), y["start"].cast("string"), y["end"].cast("string"))), ",")
    order = lambda x: F.transform(F.array_sort(F.transform(x, lambda y: F.struct(y["start"].alias("start"), y["kind"].alias("kind"), y["end"].alias("end")))), lambda y: F.struct(y["kind"].alias("kind"), y["start"].alias("start"), y["end"].alias("end")))
    out = scanned.select("row", "doc_id", "found").join(judged, "row", "left")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    plain = F.transform(base, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spell(plain).cast("binary"), 256).alias("base_sha256"),
        spell(order(F.concat(plain, F.coalesce("more", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        *(F.coalesce(F.col(f"held.{c}"), F.array().cast("array<bigint>")).alias(c) for c in ("n_owners", "n_repositories")),
    )
