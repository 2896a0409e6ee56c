"""Exact Jaccard self-join of shingle sets by PartEnum signatures, and its components.

Two sets of a and b elements have similarity t/100 or more only if they differ in at most
``(a + b) * (100 - t) / (100 + t)`` elements.  Sets are dealt into size bands.  For a band
the domain of shingles is partitioned into n parts, more than the difference d that its
sets can have, so similar sets agree on n - d parts at least.  A signature is the content
of one part.  A set signs in its own band, and in the band below if a similar smaller set
may lie there.

A set needn't sign all parts: it has slack.  Parts that are empty, or hold nothing but
shingles that a sample found to be frequent, are left out by all sets alike; let there be e
of them.  A set may leave out x more of its own choice, those with the fewest elements, as
long as ``e + 2x < n - d``: two similar sets then still share a signed part.  A set with
too many frequent parts signs them all (it can only meet its like there); one with too
many empty parts signs again under another partition.  Sets of few shingles, where a
similar pair must be one within the other, sign by enumerating subsets.

No link is lost, whatever the sample says.  Equal sets are one node, named by 128 bits, so
that copies never meet as pairs.  Nodes of a signature are linked in a star first.  What
that leaves apart is compared within the group: sketches say which nodes may have a link to
another component, those get their texts, and links are verified from the nearest on and
come out as a forest.  A large group is dealt in slices, and only nodes outside its largest
component visit the slices of others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bitmaps import bitmap, is_set
from strandline.llm.shared import lean, partitions, remove, strings, written
from strandline.llm.shingles import mix, shingle_set
from strandline.operators.graph import connected_components

SEEDS = 8
#: Signatures that a task holds before it hands them on.
FLUSH = 500_000
#: A sketch has 2 ** MOST_REGIONS regions at most.
MOST_REGIONS = 14
#: Nodes, and shingles, of a slice of a group; pairs of a star's slice.
SLICE_NODES, SLICE_SHINGLES, SLICE_PAIRS = 2048, 1 << 21, 4_000
#: Bytes of sketches that are compared at a time.
BLOCK_BYTES = 1 << 22
C1, C2, C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Bands:
    """Which instances a set of s shingles signs in: (instance, parts, largest difference)."""

    def __init__(self, percent: int) -> None:
        self.t = percent
        self.small = -(-(100 + percent) // (100 - percent)) - 1 if percent < 100 else 1 << 30

    def difference(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.t) // (100 + self.t)

    def largest(self, a: int) -> int:
        return a * 100 // self.t

    def subsets(self, s: int) -> list[int]:
        """Sizes of the subsets that a set signs: of itself and of smaller sets that it can contain."""
        return [a for a in range(1, min(s, self.small) + 1) if self.largest(a) > a and s <= self.largest(a)]

    def bands(self, s: int) -> Iterator[tuple[int, int, int]]:
        if s <= self.small:
            return
        j, lo = 0, self.small + 1
        while s >= 2 * lo:
            j, lo = j + 1, 2 * lo
        hi = 2 * lo - 1
        yield j, self.parts(hi), self.difference(s, self.largest(s))
        below = lo - 1
        if j and s <= self.largest(below):
            yield j - 1, self.parts(below), self.difference(s, below)

    def parts(self, hi: int) -> int:
        return max(-(-3 * self.difference(hi, self.largest(hi)) // 2), self.difference(hi, self.largest(hi)) + 1, 8)


def signatures(shingles: np.ndarray, bands: Bands, frequent: np.ndarray) -> np.ndarray:
    """All signatures of a set, given sorted frequent shingles."""
    s = len(shingles)
    out: list[np.ndarray] = []
    content = mix(shingles ^ C1)
    for a in bands.subsets(s):
        sums = np.array([np.add.reduce(content[list(c)]) for c in itertools.combinations(range(s), a)], np.uint64)
        out.append(mix(sums + np.full(1, a, np.uint64) * C2))
    rare = None
    for j, n, d in bands.bands(s):
        if rare is None:
            at = np.searchsorted(frequent, shingles)
            rare = np.ones(s, bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] != shingles
        for seed in range(SEEDS):
            base = np.full(1, (j * SEEDS + seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
            part = ((mix(shingles + base) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            size = np.bincount(part, minlength=n)
            selective = np.bincount(part, weights=rare, minlength=n)
            filled = np.flatnonzero(size)
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, part, content)
            signed = mix(sums + np.arange(1, n + 1, dtype=np.uint64) * C2 + base * C3)
            room = n - d - 1
            left_out = int((selective == 0).sum())
            if left_out <= room:
                x = (room - left_out) // 2
                chosen = np.flatnonzero(selective)
                if x:
                    chosen = chosen[np.argsort(selective[chosen], kind="stable")[x:]]
                out.append(signed[chosen])
                break
            if n - len(filled) <= room:
                out.append(signed[filled])
                break
            out.append(signed if seed == SEEDS - 1 else signed[filled])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(shingles: np.ndarray) -> bytes:
    """A set's 128-bit hash: equal sets are one node."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        x = np.array([np.add.reduce(mix(shingles ^ C3)) + n * C1, np.add.reduce(mix(shingles ^ C2)) + n * C3], np.uint64)
    return mix(x).tobytes()


def short(nodes: np.ndarray) -> np.ndarray:
    """The first half of each node's name (S16), by which groups know nodes: two nodes of one short name only make a group larger."""
    return np.ascontiguousarray(np.ascontiguousarray(nodes).view("<i8").reshape(-1, 2)[:, 0])


def sketch_of(shingles: np.ndarray) -> bytes:
    """Elements in each region of the domain, 2 at most, as two bit planes (at least 1, at least 2).

    Two sets differ in as many elements as their counts do, or more; the planes differ in
    as many bits.  A set has two regions an element or more, 64 at least.
    """
    bits = min(max((2 * len(shingles) - 1).bit_length(), 6), MOST_REGIONS)
    return planes(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)[None]).tobytes()


def planes(counts: np.ndarray) -> np.ndarray:
    return np.packbits(np.concatenate([counts >= 1, counts >= 2], axis=1), axis=1)


def folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches of half as many regions."""
    out = np.empty((len(sketches), sketches.shape[1] // 2), np.uint8)
    step = max(1, BLOCK_BYTES // (8 * sketches.shape[1]))
    for lo in range(0, len(sketches), step):
        part = sketches[lo : lo + step]
        counts = np.unpackbits(part, axis=1).reshape(len(part), 2, -1).sum(1, dtype=np.uint8)
        out[lo : lo + step] = planes(counts.reshape(len(part), -1, 2).sum(2, dtype=np.uint8))
    return out


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many elements the sets differ at least, of which these are sketches (rows of bytes; ``a`` may be one row for all)."""
    while a.shape[1] != b.shape[1]:
        a, b = (folded(a), b) if a.shape[1] > b.shape[1] else (a, folded(b))
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    out = np.empty(len(b), np.int64)
    step = max(1, BLOCK_BYTES // (8 * b.shape[1]))
    for lo in range(0, len(b), step):
        out[lo : lo + step] = np.bitwise_count((a if len(a) == 1 else a[lo : lo + step]) ^ b[lo : lo + step]).sum(1, dtype=np.int64)
    return out


def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and differences leave room for a link; true for all that are linked."""
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def rows_of(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def frequent_shingles(docs: DataFrame, rows: int, k: int, sample: int = 20_000, least: int = 5, most: int = 500_000) -> np.ndarray:
    """Shingles that ``least`` texts of a sample have, ``most`` of them at most, sorted.  They steer what is signed, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [shingle_set(t, k) for batch in batches for t in strings(batch.column(0))]
        at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    share = F.pmod(F.xxhash64("text", F.lit("frequent")), F.lit(1 << 20)) < F.lit(min(1.0, sample / max(rows, 1)) * (1 << 20))
    # equal texts fall into the sample together, and are one there
    counted = docs.where(share).select("text").distinct().mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.unique(top["shingle"].to_numpy().view(np.uint64))


def _signed(docs: DataFrame, bands: Bands, frequent: np.ndarray, k: int) -> DataFrame:
    """One scan: (doc_id, n, node, sketch, short) of each document, and (gid, short) of signatures that several nodes have.

    Signatures travel as blobs: nodes, how many signatures each has there, and six bytes of
    each signature, whose other bits are the bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by frequent_shingles
    count = 1 << max(partitions(docs, 4) - 1, 1).bit_length()
    bits = np.uint64(count.bit_length() - 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, nodes, size, seen = [], [], 0, set()
        names = ["bucket", "nodes", "counts", "sigs", "doc_id", "n", "node", "sketch"]

        def flushed() -> Iterator[pa.RecordBatch]:
            sig = np.concatenate(held)
            named = short(np.frombuffer(b"".join(nodes), "S16"))
            node = np.repeat(np.arange(len(nodes)), [len(x) for x in held])
            bucket = (sig >> (np.uint64(64) - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, node, bucket = sig[order], node[order], bucket[order]
            low = (sig << bits) >> np.uint64(16)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                first = np.flatnonzero(np.concatenate([[True], node[lo + 1 : hi] != node[lo : hi - 1]]))
                rows.append((int(bucket[lo]), named[node[lo:hi][first]].tobytes(), np.diff(first, append=hi - lo).astype("<u4").tobytes(), low[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            yield blobs(rows)

        def blobs(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), *none], names=names)

        for batch in batches:
            n, keys, sketches = [], [], []
            for text in strings(batch.column(1)):
                s = shingle_set(text, k)
                key = node_of(s) if len(s) else None
                n.append(len(s))
                keys.append(key)
                sketches.append(sketch_of(s) if len(s) else None)
                if key is None or key in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                found = signatures(s, bands, shared.value)
                if len(found):
                    held.append(found)
                    nodes.append(key)
                    size += len(found)
                if size >= FLUSH:
                    yield from flushed()
                    held, nodes, size = [], [], 0
            bucket = pa.array(np.arange(len(n), dtype=np.int32) % count, pa.int32())
            none = [pa.nulls(len(n), pa.binary()) for _ in range(3)]
            yield pa.RecordBatch.from_arrays([bucket, *none, batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=names)
        if held:
            yield from flushed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[tuple[np.ndarray, bytes, np.ndarray]] = []
        now = None

        def met() -> Iterator[pa.RecordBatch]:
            sigs, nodes, counts = zip(*held, strict=True)
            sig, node = np.concatenate(sigs), np.repeat(np.frombuffer(b"".join(nodes), "<i8"), np.concatenate(counts))
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
            sig, node = sig[fresh], node[fresh]
            group = np.cumsum(np.concatenate([[True], sig[1:] != sig[:-1]])) - 1
            several = np.bincount(group)[group] > 1
            if several.any():
                yield from distinct_groups(group[several], node[several])

        for batch in batches:
            plain = pa.compute.is_null(batch.column(1))
            if pa.compute.any(plain).as_py():
                own = batch.filter(plain)
                first = short(np.frombuffer(b"".join(x or bytes(16) for x in own.column(6).to_pylist()), "S16"))
                yield pa.RecordBatch.from_arrays([*own.columns[4:], pa.nulls(len(own), pa.int64()), pa.array(first)], names=["doc_id", "n", "node", "sketch", "gid", "short"])
            for bucket, nodes, counts, sigs in zip(*(c.to_pylist() for c in batch.filter(pa.compute.invert(plain)).columns[:4]), strict=True):
                if bucket != now and held:
                    yield from met()
                    held = []
                now = bucket
                low = np.zeros((len(sigs) // 6, 8), np.uint8)
                low[:, :6] = np.frombuffer(sigs, np.uint8).reshape(-1, 6)
                held.append((low.view("<u8").ravel(), nodes, np.frombuffer(counts, "<u4")))
        if held:
            yield from met()

    signed = docs.select("doc_id", "text").mapInArrow(sign, "bucket int, nodes binary, counts binary, sigs binary, doc_id long, n long, node binary, sketch binary")
    return signed.repartition(partitions(docs), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "doc_id long, n long, node binary, sketch binary, gid long, short long")


def distinct_groups(group: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Groups of the same nodes (short names) are one; a group's id is a hash of its nodes."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    gid = mix(np.add.reduceat(mix(node.view(np.uint64) ^ C2), starts))
    sizes = np.diff(starts, append=len(group))
    order = np.lexsort((node[starts], sizes, gid))
    alike = (np.diff(gid[order]) == 0) & (np.diff(sizes[order]) == 0) & (np.diff(node[starts][order]) == 0)
    keep = np.zeros(len(starts), bool)
    keep[order[np.concatenate([[True], ~alike])]] = True
    rows = np.repeat(keep, sizes)
    n = int(rows.sum())
    none = lambda t: pa.nulls(n, t)
    yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary()), pa.array(np.repeat(gid, sizes)[rows].view(np.int64)), pa.array(node[rows])], names=["doc_id", "n", "node", "sketch", "gid", "short"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _unzipped(z: bytes, unzip: zstandard.ZstdDecompressor, k: int) -> np.ndarray:
    return shingle_set(unzip.decompress(z).decode("utf-8", "surrogatepass"), k)


def _by_hub(pairs: DataFrame, side: DataFrame, parts: int, slices: int) -> DataFrame:
    """Rows (a, slice, b, columns of ``side``) for the pairs, each hub before its members, with a null b.

    A hub's members are dealt in slices, and it goes to each slice that it has members in.
    """
    dealt = pairs.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(slices)))
    rest = [c for c in side.columns if c != "node"]
    members = dealt.join(side, dealt["b"] == side["node"]).select("a", "slice", "b", *rest)
    hubs = dealt.select("a", "slice").distinct().join(side, F.col("a") == side["node"]).select("a", "slice", F.lit(None).cast("binary").alias("b"), *rest)
    return hubs.union(members).repartition(parts, "a", "slice").sortWithinPartitions("a", "slice", "b")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int, parts: int, slices: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar; texts has (node, z) with the zipped text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        unzip, hub = zstandard.ZstdDecompressor(), np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, z in zip(*(strings(batch.column(c)) for c in (0, 2, 3)), strict=True):
                own = _unzipped(z, unzip, k)
                if b is None:
                    hub = own
                elif similar(hub, own, percent):
                    out.append((a, b))
            yield _pairs(out)

    return _by_hub(pairs, texts, parts, slices).mapInArrow(run, "a binary, b binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, node) of the groups' rows, each group's hub first: the node that most groups have, a text that others were made of."""
    lean()
    gid = hub = None
    for batch in batches:
        out = []
        for g, node in zip(*map(strings, batch.columns[:2]), strict=True):
            if g != gid:
                gid, hub = g, node
            else:
                out.append((hub, node))
        yield _pairs(out)


def _near(pairs: DataFrame, nodes: DataFrame, percent: int, parts: int, slices: int) -> DataFrame:
    """The pairs whose sizes and sketches leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hub = None
        for batch in batches:
            out, block = [], []

            def near() -> Iterator[tuple[bytes, bytes]]:
                for size in {len(r[4]) for r in block}:
                    own = [r for r in block if len(r[4]) == size]
                    apart = differences(rows_of([hub[1]]), rows_of([r[4] for r in own]))
                    ok = may_link(np.full(len(own), hub[0]), np.array([r[3] for r in own]), apart, percent)
                    yield from ((r[0], r[2]) for r, x in zip(own, ok, strict=True) if x)

            for row in zip(*map(strings, batch.columns), strict=True):
                if row[2] is None:
                    out += near()
                    hub, block = row[3:5], []
                else:
                    block.append(row)
            out += near()
            yield _pairs(out)

    return _by_hub(pairs, nodes.select("node", "n", "sketch"), parts, slices).mapInArrow(run, "a binary, b binary")


def _texts(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, z): a zipped text for each node.  A bitmap of bounded size spares the other texts the shuffle."""
    chosen, bits = bitmap(nodes.select(F.xxhash64("doc_id").alias("h")))
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        zipper = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            h = batch.column(2).to_numpy().view(np.uint64)
            some = batch.filter(pa.array(is_set(shared.value, h, bits)))
            texts = some.column(1).to_pylist()
            found = [node_of(s) if len(s := shingle_set(t, k)) else None for t in texts]
            z = [zipper.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary()), pa.array(z, pa.binary())], names=["doc_id", "node", "z"])

    found = rows.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(zipped, "doc_id long, node binary, z binary").alias("f")
    own = nodes.select("node", "doc_id").alias("o")
    same = (F.col("f.node") == F.col("o.node")) & F.col("f.doc_id").eqNullSafe(F.col("o.doc_id"))
    return found.join(own, same).select("f.node", "f.z").dropDuplicates(["node"])


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes that some pair has."""
    return nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi")


def candidates(n: np.ndarray, c: np.ndarray, visits: np.ndarray, sketches: list[bytes], percent: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, places, least difference) of a slice's nodes of different components that may be linked; of two visitors neither."""
    level = np.array([len(x) for x in sketches])
    kinds = np.unique(level).tolist()
    planes = {k: rows_of([x for x in sketches if len(x) == k]) for k in kinds}
    for p, x in enumerate(kinds):
        for y in kinds[p : p + 2]:
            if y > 2 * x:
                continue
            left, right = np.flatnonzero(level == x), np.flatnonzero(level == y)
            other = planes[y] if x == y else folded(planes[y])
            for i in range(0, len(left), block):
                for j in range(i if x == y else 0, len(right), block):
                    u, v = left[i : i + block], right[j : j + block]
                    ok = (c[u, None] != c[None, v]) & ~(visits[u, None] & visits[None, v]) & (np.minimum(n[u, None], n[None, v]) * 100 >= np.maximum(n[u, None], n[None, v]) * percent)
                    if x == y:
                        ok &= u[:, None] < v[None]
                    a, b = np.nonzero(ok)
                    few = max(64, BLOCK_BYTES // x)
                    for lo in range(0, len(a), few):
                        s, t = a[lo : lo + few], b[lo : lo + few]
                        apart = differences(planes[x][i : i + block][s], other[j : j + block][t])
                        keep = may_link(n[u[s]], n[v[t]], apart, percent)
                        if keep.any():
                            yield u[s[keep]], v[t[keep]], apart[keep]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (gid, slice), which come one after the other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*map(strings, batch.columns), strict=True):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _alive(percent: int):
    """Of rows (gid, slice, node, n, c, visits, sketch): those that may have a link to another component of their slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for rows in _sliced(batches):
            n, visits = np.array([r[3] for r in rows], np.int64), np.array([r[5] for r in rows], bool)
            c = np.unique(np.array([r[4] for r in rows], "S16"), return_inverse=True)[1]
            hit = np.zeros(len(rows), bool)
            for s, t, _ in candidates(n, c, visits, [r[6] for r in rows], percent):
                hit[s] = hit[t] = True
            some = [rows[i] for i in np.flatnonzero(hit).tolist()]
            if some:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*some, strict=True), kinds, strict=True)], names=["gid", "slice", "node", "n", "c", "visits", "sketch"])

    return run


def _forest(percent: int, k: int, most_failed: int = 1_000_000):
    """Of rows (gid, slice, node, n, c, visits, sketch, z): links that join the components of a slice, fewer than it has nodes.

    Pairs are verified from the nearest on; a pair whose components are joined already needn't be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        unzip = zstandard.ZstdDecompressor()
        failed: set[tuple[bytes, bytes]] = set()
        for rows in _sliced(batches):
            n, visits = np.array([r[3] for r in rows], np.int64), np.array([r[5] for r in rows], bool)
            root = np.unique(np.array([r[4] for r in rows], "S16"), return_inverse=True)[1]
            found = list(candidates(n, root, visits, [r[6] for r in rows], percent))
            if not found:
                continue
            s, t, apart = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(apart, kind="stable")
            s, t = s[order], t[order]
            sets: dict[int, np.ndarray] = {}
            size = 0

            def known(i: int, rows: list[tuple] = rows, sets: dict[int, np.ndarray] = sets) -> np.ndarray:
                nonlocal size
                if i not in sets:
                    if size > 2 * SLICE_SHINGLES:
                        sets.clear()
                        size = 0
                    sets[i] = _unzipped(rows[i][7], unzip, k)
                    size += len(sets[i])
                return sets[i]

            out, lo = [], 0
            while lo < len(s):
                i, j = int(s[lo]), int(t[lo])
                lo += 1
                if root[i] == root[j]:
                    continue
                pair = (min(rows[i][2], rows[j][2]), max(rows[i][2], rows[j][2]))
                if pair in failed:
                    continue
                if similar(known(i), known(j), percent):
                    out.append(pair)
                    root[root == root[j]] = root[i]
                    apart = root[s[lo:]] != root[t[lo:]]
                    s, t, lo = s[lo:][apart], t[lo:][apart], 0
                elif len(failed) < most_failed:
                    failed.add(pair)
            if out:
                yield _pairs(out)

    return run


def _joined(groups: DataFrame, nodes: DataFrame, links: DataFrame, texts: DataFrame, rows: DataFrame, percent: int, k: int, parts: int, done: list[str]) -> DataFrame:
    """(a, b): links between the components that the links so far leave apart within a group."""
    found = connected_components(links, "a", "b")
    sized = found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", F.col("component").alias("c"), "size")
    known = nodes.select("node", "n").join(sized, "node", "left").select("node", "n", F.coalesce("c", "node").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
    labelled = groups.select("gid", "node").join(known, "node")
    whole = labelled.groupBy("gid").agg(F.max(F.struct("size", "c")).alias("largest"), F.count("*").alias("nodes"), F.sum("n").alias("n"), (F.min("c") != F.max("c")).alias("apart"))
    slices = F.greatest(F.ceil(F.col("nodes") / SLICE_NODES), F.ceil(F.col("n") / SLICE_SHINGLES)).cast("long")
    whole = whole.where("apart").select("gid", F.col("largest.c").alias("largest"), slices.alias("slices"))
    rest = labelled.join(whole, "gid").withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")))
    to = F.when(F.col("c") == F.col("largest"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    rest = rest.withColumn("slice", F.explode(to)).select("gid", "slice", "node", "c", (F.col("slice") != F.col("own")).alias("visits"))
    # sketches come last: a node's rows lie side by side then, and are sent as good as once
    rest = rest.join(nodes.select("node", "n", "sketch"), "node").select("gid", "slice", "node", "n", "c", "visits", "sketch")
    kind = "gid long, slice long, node binary, n long, c binary, visits boolean, sketch binary"
    alive = written(rest.repartition(parts, "gid", "slice").sortWithinPartitions("gid", "slice").mapInArrow(_alive(percent), kind), "alive", done)
    # slices whose nodes that are left are the same ones are one
    row = F.xxhash64("node", "visits"), F.xxhash64("visits", "node", F.lit(1))
    same = alive.groupBy("gid", "slice").agg(F.count("*").alias("rows"), *(F.bit_xor(x).alias(c) for c, x in zip("xy", row, strict=True)))
    one = same.groupBy("rows", "x", "y").agg(F.min(F.struct("gid", "slice")).alias("one")).select("one.*")
    alive = written(alive.join(one, ["gid", "slice"], "left_semi"), "alive", done)
    more = nodes.join(alive.select("node").distinct(), "node", "left_semi").join(texts.select("node"), "node", "left_anti")
    texts = texts.unionByName(_texts(rows, more, k))
    with_texts = alive.join(texts, "node").select(*alive.columns, "z")
    return with_texts.repartition(parts, "gid", "slice").sortWithinPartitions("gid", "slice").mapInArrow(_forest(percent, k), "a binary, b binary")


def jaccard_components(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links of ``percent`` or more reach.

    A text without words has no shingles and no links.  Rows with equal sets are linked,
    repeated rows and rows with null ids too; a component of null ids only has a null id.
    A similarity of exactly ``percent`` is a link.  Other columns are not looked at.  A
    text of any length is hashed in parts of bounded size; a task holds its set.  No rows
    give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = frequent_shingles(rows, rows.count(), k)
    signed = written(_signed(rows, Bands(percent), frequent, k), "signed")
    done: list[str] = []  # tables that the result doesn't read
    sets = signed.where("gid IS NULL").drop("gid")
    members = signed.where("gid IS NOT NULL").select("gid", "short")
    alike = sets.where("node IS NOT NULL").groupBy("short", "node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(alike.join(members.select("short").distinct(), "short", "left_semi"), "nodes", done)
    listed = members.join(nodes.select("short", "node"), "short").groupBy("short", "node").agg(F.collect_set("gid").alias("gids"))
    groups = written(listed.select("node", F.size("gids").alias("degree"), F.explode("gids").alias("gid")), "groups", done)
    nodes = nodes.drop("short")
    parts = partitions(rows)
    ordered = groups.select("gid", "node", "degree").repartition(parts, "gid").sortWithinPartitions("gid", F.desc("degree"), F.desc("node"))
    stars = written(ordered.mapInArrow(_stars, "a binary, b binary").distinct(), "stars", done)
    slices = max(1, min(stars.count() // SLICE_PAIRS, 1 << 16))
    stars = written(_near(stars, nodes, percent, parts, slices), "near", done)
    texts = written(_texts(rows, _of(nodes, stars), k), "texts", done)
    links = written(_verified(stars, texts, percent, k, parts, slices), "links")
    links = links.union(written(_joined(groups, nodes, links, texts, rows, percent, k, parts, done), "links"))
    final = connected_components(links, "a", "b")
    for path in done:
        remove(rows.sparkSession, path)

    reached = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    reached = reached.join(final, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c"))
    least = reached.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = reached.join(least, "c").select("node", "component_id")
    return sets.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
