"""Similarity of sequences by shared canonical k-mers: a stated stand-in for alignment.

``identity`` is estimated from the containment c of the smaller k-mer set as c ** (1/k),
which is exact for evenly spread substitutions.  Thresholds are those of the alignment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.graph import _folder

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: k-mers that a task deals together, and about as many as a bucket of them has; a k-mer of more holders than ``LIGHT`` is joined on its own.
BLOCK, BUCKET, LIGHT = 1 << 20, 1 << 24, 8
#: k-mers that a bucket looks at together to make pairs of their holders, and letters of a k-mer up to which its letters are its number.
HELD, SHORT = 1 << 20, 16
CODE = np.full(256, 4, np.uint8)
CODE[[ord(c) for c in "ACGT"]] = range(4)
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def canonical(seq: str, k: int) -> np.ndarray:
    """The distinct canonical k-mers of a sequence as 64-bit numbers, sorted; a k-mer and its reverse complement are one.

    A k-mer of A, C, G and T only, ``SHORT`` of them at most, is two bits a letter.  Any
    other is a hash, a polynomial in its letters, so that all places of a sequence, and of
    its reverse complement, are hashed at once; where both occur, hashes are below 0.
    """
    letters = np.frombuffer(seq.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    other = letters.copy()
    for x, y in zip("ACGT", "TGCA", strict=True):
        other[letters == ord(x)] = ord(y)
    ahead, behind = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        ahead = ahead * MULTIPLIER + letters[i : i + n]
        behind = behind * MULTIPLIER + other[k - 1 - i : k - 1 - i + n]
    both = []
    for x in (ahead, behind):
        x = (x ^ (x >> np.uint64(32))) * MIXER
        both.append(x ^ (x >> np.uint64(29)))
    found = np.minimum(*both)
    if k <= SHORT:
        plain = CODE[np.minimum(letters, 255)]
        found = np.where(_only_plain(plain, k), _codes(plain, k), found | np.uint64(1 << 63))
    return np.unique(found.view(np.int64))


def _only_plain(plain: np.ndarray, k: int) -> np.ndarray:
    odd = np.concatenate([[0], np.cumsum(plain > 3)])
    return odd[k:] == odd[:-k]


def _codes(plain: np.ndarray, k: int) -> np.ndarray:
    """The letters of each k-mer, two bits each, or of its reverse complement if that is the smaller number."""
    n = len(plain) - k + 1
    x = (plain & 3).astype(np.uint32)
    ahead, behind = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for i in range(k):
        ahead <<= np.uint32(2)
        ahead |= x[i : i + n]
        behind |= (np.uint32(3) - x[i : i + n]) << np.uint32(2 * i)
    return np.minimum(ahead, behind).astype(np.uint64)


def _held(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers, number of the list) of lists of k-mers, or of sequences; of sequences a list may have a k-mer many times."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), sizes)
    flat = lists.flatten()
    if pa.types.is_integer(flat.type):
        return flat.to_numpy(zero_copy_only=False), of
    flat = flat.cast(pa.large_string())
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    plain = CODE[np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    odd = np.concatenate([[0], np.cumsum(plain > 3)])
    slow = np.flatnonzero(odd[ends[1:]] > odd[ends[:-1]]) if k <= SHORT else np.arange(len(flat))
    values, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in slow.tolist():
        values.append(canonical(flat[i].as_py(), k))
        owner.append(np.full(len(values[-1]), of[i]))
    if len(slow) < len(flat) and len(plain) >= k:
        string = np.repeat(np.arange(len(flat)), np.diff(ends))[: len(plain) - k + 1]
        good = np.ones(len(flat), bool)
        good[slow] = False
        at = np.flatnonzero((np.arange(len(string)) + k <= ends[string + 1]) & good[string])
        values.append(_codes(plain, k)[at].view(np.int64))
        owner.append(of[string[at]])
    return np.concatenate(values), np.concatenate(owner)


def kmer_sets(df: DataFrame, id_col: str, seq: str = "seq", k: int = 16) -> DataFrame:
    """(id, kmers): hashes without repeats, sorted; an id's sequences are taken together, and a null one has none.

    Made in Arrow batches: as an expression on strings the same costs some forty times as
    much.  Letters are shuffled, which are an eighth of the hashes.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(lists: pa.Array) -> pa.Array:
        found = [np.unique(np.concatenate([np.zeros(0, np.int64), *(canonical(s, k) for s in seqs.as_py())])) for seqs in lists]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    own = df.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.col(seq)).alias("seqs"))
    return own.select("id", of("seqs").alias("kmers"))


@F.arrow_udf(T.StringType())
def _digest(kmers: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.values.to_numpy(zero_copy_only=False).tobytes()).hexdigest() for x in kmers])


def _written(df: DataFrame) -> DataFrame:
    """The rows, written once; what the writing job has shuffled is deleted when it ends."""
    path, conf = _folder(df), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # planned anew, so that the setting holds for it
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def classes(sets: DataFrame) -> DataFrame:
    """(id, class, n) of ids with n k-mers; ids with equal k-mer sets are a class, named by its smallest id."""
    keys = sets.where(F.size("kmers") > 0).select("id", F.size("kmers").alias("n"), _digest("kmers").alias("key"))
    keys = _written(keys)
    return _written(keys.join(keys.groupBy("key").agg(F.min("id").alias("class")), "key").select("id", "class", "n"))


def dealt_join(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, most: int) -> DataFrame:
    """The inner equi-join; keys with more than ``most`` rows on a side are cut into slices of the ids there, and each pair of slices is a key of its own."""
    l, r = (x.groupBy(on).agg(F.ceil(F.count("*") / most).cast("int").alias(c)) for x, c in ((left, "__nl"), (right, "__nr")))
    hot = l.join(r, on).where("__nl > 1 OR __nr > 1")
    slice_of = lambda c, n: F.pmod(F.xxhash64(c), F.coalesce(n, F.lit(1))).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    own = left.join(hot, on, "left").withColumn("__l", slice_of(left_id, F.col("__nl"))).withColumn("__r", all_of(F.col("__nr"))).drop("__nl", "__nr")
    other = right.join(hot, on, "left").withColumn("__r", slice_of(right_id, F.col("__nr"))).withColumn("__l", all_of(F.col("__nl"))).drop("__nl", "__nr")
    return own.join(other, [on, "__l", "__r"]).drop("__l", "__r")


def incidence(rows: DataFrame, held: Column) -> DataFrame:
    """(side, id, kmer, weight) of the k-mers whose holders fulfil ``held``: k-mers with the same holders are one, with their number.

    Holders are told apart by their number and 128 bits of hashes.
    """
    alike = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("side", "id")).alias("a"), F.bit_xor(F.xxhash64("id", "side", F.lit(1))).alias("b"), F.min("side").alias("first"), F.max("side").alias("last")]
    kinds = rows.groupBy("kmer").agg(*alike).where(held).groupBy("n", "a", "b").agg(F.min("kmer").alias("kmer"), F.count("*").alias("weight"))
    return _written(rows.join(kinds.select("kmer", "weight"), "kmer").select("side", "id", "kmer", "weight"))


def met(sets: DataFrame, count: int, two_sides: bool, share: float = 0.0, k: int = 16) -> DataFrame:
    """(side, query, target, kmer, shared, n_query, n_target) out of the sets (side, id, kmers), each (side, id) once; n is a set's size.

    In place of k-mers there may be lists of sequences.  Sets are dealt to buckets by their
    k-mers, which are packed: one of two bits a letter is four bytes there, any other
    eight.  A bucket finds what several sets hold.  For k-mers of few holders it gives
    pairs with the number that they share in it; a holder of a common k-mer is a row
    (side, query, null, kmer).  Pairs are between the sides or, on one side, in order of the ids.

    With ``share`` a pair is given only by buckets in which it shares as many as all must
    have on average, for that share of the smaller set's k-mers: one of them then has so many.
    """
    kind = sets.schema["id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lists = batch.column(2)
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ends = first[1:]
            if not pa.types.is_integer(lists.type.value_type):  # by letters
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False))])[first[1:]]
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(ends, (int(ends[lo - 1]) if lo else 0) + BLOCK, side="right")))
                yield from dealt(sides[lo:hi], ids.slice(lo, hi - lo), *_held(lists.slice(lo, hi - lo), k))
                lo = hi

    def dealt(sides: np.ndarray, ids: pa.Array, kmers: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(kmers):
            return
        wide = bool(((kmers < 0) | (kmers >= 1 << 32)).any())
        slot = ((kmers.view(np.uint64) * MULTIPLIER) >> np.uint64(32)) % np.uint64(count) * np.uint64(len(ids)) + owner.astype(np.uint64)
        if wide or count * len(ids) >= 1 << 32:
            order = np.lexsort((kmers, slot))
            kmers, slot = kmers[order], slot[order]
            new = np.concatenate([[True], (kmers[1:] != kmers[:-1]) | (slot[1:] != slot[:-1])])
            kmers, slot = kmers[new], slot[new]
        else:  # one sort deals them and tells equal ones
            key = slot << np.uint64(32) | kmers.view(np.uint64)
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            kmers, slot = key.astype(np.uint32), key >> np.uint64(32)
        kmers = kmers.astype("<i8" if wide else "<u4")
        heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        of, who = (x.astype(np.int64) for x in np.divmod(slot[heads], np.uint64(len(ids))))
        counts = np.diff(heads, append=len(kmers)).astype("<u4")
        n = np.bincount(who, counts, len(ids)).astype("<i4")[who]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        edges = [*heads.tolist(), len(kmers)]
        ranges = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(of[cuts].astype(np.int32)),
                pa.array([wide] * len(cuts)),
                pa.array([sides[who[x:y]].astype(np.int8).tobytes() for x, y in ranges]),
                pa.ListArray.from_arrays(pa.array([*cuts, len(of)], pa.int32()), ids.take(pa.array(who))),
                pa.array([n[x:y].tobytes() for x, y in ranges]),
                pa.array([counts[x:y].tobytes() for x, y in ranges]),
                pa.array([kmers[edges[x] : edges[y]].tobytes() for x, y in ranges]),
            ],
            names=["bucket", "wide", "sides", "ids", "n", "counts", "kmers"],
        )

    def found(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides, sizes, counts = (np.concatenate([np.frombuffer(x[i].as_buffer(), t) for x in held]) for i, t in ((1, "i1"), (3, "<i4"), (4, "<u4")))
        wide = any(x[0].as_py() for x in held)
        kmers = np.concatenate([np.frombuffer(x[5].as_buffer(), "<i8" if x[0].as_py() else "<u4").astype("<i8" if wide else "<u4", copy=False) for x in held])
        ids = pa.concat_arrays([x[2].values for x in held])
        by_id = pc.sort_indices(ids).to_numpy()
        rank = np.empty(len(by_id), np.uint32)
        rank[by_id] = np.arange(len(by_id))
        ids, sides, sizes, owner = ids.take(pa.array(by_id)), sides[by_id], sizes[by_id].astype(np.int64), np.repeat(rank, counts)
        held.clear()
        if wide:
            order = np.argsort(kmers)
            kmers, owner = kmers[order], owner[order]
        else:
            key = kmers.astype(np.uint64)
            key <<= np.uint64(32)
            key |= owner
            key.sort()
            owner = key.astype(np.uint32)
            key >>= np.uint64(32)
            kmers = key.astype(np.int64)
            del key
        starts = np.flatnonzero(np.concatenate([[True], kmers[1:] != kmers[:-1]]))
        n = np.diff(starts, append=len(kmers))
        if two_sides:
            ones = np.add.reduceat(sides[owner].astype(np.int64), starts)
            several = (ones > 0) & (ones < n)
        else:
            several = n > 1
        codes = [np.zeros(0, np.int64)]
        for m in range(2, LIGHT + 1):
            those = starts[several & (n == m)]
            for lo in range(0, len(those), HELD):
                holders = owner[those[lo : lo + HELD, None] + np.arange(m)].astype(np.int64)
                for i in range(m):
                    for j in range(i + 1, m):
                        a, b = np.minimum(holders[:, i], holders[:, j]), np.maximum(holders[:, i], holders[:, j])
                        if two_sides:
                            apart = sides[a] != sides[b]
                            a, b = a[apart], b[apart]
                            a, b = np.where(sides[a] == 0, a, b), np.where(sides[a] == 0, b, a)
                        codes.append(a * len(ids) + b)
        pairs = np.concatenate(codes)
        del codes
        pairs.sort()
        heads = np.flatnonzero(np.concatenate([np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]]))
        pairs, shared = pairs[heads], np.diff(heads, append=len(pairs))
        for lo in range(0, len(pairs), 1 << 16):
            (a, b), c = np.divmod(pairs[lo : lo + (1 << 16)], len(ids)), shared[lo : lo + (1 << 16)]
            if share:
                enough = c >= np.ceil(share * np.minimum(sizes[a], sizes[b]) / count * (1 - 1e-9))
                a, b, c = a[enough], b[enough], c[enough]
            if len(a):
                yield _row_batch(pa.nulls(len(a), pa.int32()), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.nulls(len(a), pa.int64()), pa.array(c), pa.array(sizes[a]), pa.array(sizes[b]))
        at = np.flatnonzero(np.repeat(several & (n > LIGHT), n))
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            who = owner[some]
            none = pa.nulls(len(some), pa.int64())
            yield _row_batch(pa.array(sides[who].astype(np.int32)), ids.take(pa.array(who)), pa.nulls(len(some), ids.type), pa.array(kmers[some]), none, pa.array(sizes[who]), none)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for i, at in enumerate(batch.column(0).to_pylist()):
                if held and at != bucket:
                    raise ValueError("a task has one bucket")
                bucket = at
                held.append(tuple(c[i] for c in batch.columns[1:]))
        if held:
            yield from found(held)

    packets = sets.select("side", "id", sets.columns[-1]).mapInArrow(deal, f"bucket int, wide boolean, sides binary, ids array<{kind}>, n binary, counts binary, kmers binary")
    return packets.repartitionById(count, "bucket").mapInArrow(meet, f"side int, query {kind}, target {kind}, kmer long, shared long, n_query long, n_target long")


def _row_batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["side", "query", "target", "kmer", "shared", "n_query", "n_target"])


def _buckets(df: DataFrame, size: int, most: int | None = None) -> int:
    """Buckets for so many k-mers: as many as tasks, or ``most`` if that is less, and more where they would be too large."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks if most is None else min(tasks, most), -(-size // BUCKET), 1)


def _counted(rows: DataFrame, two_sides: bool, most_common: int) -> DataFrame:
    """(query, target, shared, buckets, n_query, n_target) of the pairs in the written rows of ``met``, and how many buckets gave them.

    A k-mer that more than ``most_common`` classes have is dealt out in slices; none is left out.
    """
    light = rows.where("kmer IS NULL").select("query", "target", "shared", F.lit(1).alias("buckets"), "n_query", "n_target")
    common = rows.where("kmer IS NOT NULL").select("side", F.col("query").alias("id"), "kmer")
    sizes = rows.where("kmer IS NOT NULL").select("side", F.col("query").alias("id"), F.col("n_query").alias("n")).distinct()
    common = incidence(common, F.col("first") < F.col("last") if two_sides else F.col("n") > 1).join(sizes, ["side", "id"])
    left, right = (common.where("side = 0"), common.where("side = 1")) if two_sides else (common, common)
    left, right = left.select(F.col("id").alias("query"), "kmer", "weight", F.col("n").alias("n_query")), right.select(F.col("id").alias("target"), "kmer", F.col("n").alias("n_target"))
    pairs = dealt_join(left, right, "kmer", "query", "target", most_common)
    if not two_sides:
        pairs = pairs.where("query < target")
    pairs = light.union(pairs.select("query", "target", "weight", F.lit(0), "n_query", "n_target"))
    return pairs.groupBy("query", "target").agg(F.sum("shared").alias("shared"), F.sum("buckets").alias("buckets"), F.max("n_query").alias("n_query"), F.max("n_target").alias("n_target"))


def class_pairs(queries: DataFrame, of_q: DataFrame, targets: DataFrame | None = None, of_t: DataFrame | None = None, most_common: int = 1000) -> DataFrame:
    """(query, target, shared, n_query, n_target) of classes that share a k-mer; without targets, of the queries' classes among themselves."""
    own = lambda sets, of, side: sets.join(of.where("id = class").select("id"), "id", "left_semi").select(F.lit(side).alias("side"), "id", "kmers")
    sets, total, two = own(queries, of_q, 0), of_q.where("id = class"), targets is not None
    if two:
        sets, total = sets.union(own(targets, of_t, 1)), total.union(of_t.where("id = class"))
    size = total.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    pairs = _counted(_written(met(sets, _buckets(queries, size), two)), two, most_common).drop("buckets")
    if two:
        return pairs
    n = F.col("n").cast("long").alias
    pairs = pairs.union(pairs.select("target", "query", "shared", "n_target", "n_query"))
    return pairs.union(of_q.where("id = class").select(F.col("id"), F.col("id"), n("shared"), n("n_query"), n("n_target")))


def members_of(pairs: DataFrame, of_q: DataFrame, of_t: DataFrame, most_common: int = 1000) -> DataFrame:
    """Pairs of classes as pairs of their members."""
    q, t = (x.select(F.col("class").alias(f"{c}_class"), F.col("id").alias(c)) for x, c in ((of_q, "query"), (of_t, "target")))
    own = pairs.withColumnsRenamed({"query": "query_class", "target": "target_class"})
    own = dealt_join(own, q, "query_class", "target_class", "query", most_common)
    return dealt_join(own, t, "target_class", "query", "target", most_common).select("query", "target", *[c for c in pairs.columns if c not in ("query", "target")])


def shared_kmers(queries: DataFrame, targets: DataFrame, most_common: int = 1000) -> DataFrame:
    """(query, target, shared, n_query, n_target) of all pairs of k-mer sets that share a k-mer, however common it is."""
    of_q, of_t = classes(queries), classes(targets)
    return members_of(class_pairs(queries, of_q, targets, of_t, most_common), of_q, of_t, most_common)


def identity(shared: Column, smaller: Column, k: int) -> Column:
    return F.pow(shared / smaller, F.lit(1.0 / k))


def _lettered(df: DataFrame, id_col: str, seq: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(of, texts): (id, class) of the ids that have a k-mer, and (id, seqs) of the classes.

    Ids with equal sequences are a class, named by its smallest id; it is told by the
    letters, so k-mers are made only once, where they are dealt.
    """
    own = df.where(F.length(seq) >= k).groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(F.col(seq))).alias("seqs"))
    own = _written(own.withColumn("key", F.sha2(F.to_json("seqs"), 256)))
    of = _written(own.select("id", "key").join(own.groupBy("key").agg(F.min("id").alias("class")), "key").select("id", "class"))
    return of, own.select("id", "seqs").join(of.where("id = class").select("id"), "id", "left_semi")


def _kmers_within(texts: DataFrame, k: int) -> tuple[int, int]:
    """How many k-mers the texts have at most, and how many texts there are."""
    n = F.aggregate("seqs", F.lit(0).cast("long"), lambda s, x: s + F.length(x) - k + 1)
    return tuple(texts.agg(F.coalesce(F.sum(n), F.lit(0)), F.count("*")).first())


def shared_by(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Pairs (query, target and others) with ``shared``, counted from the sequences of both."""

    @F.arrow_udf(T.LongType())
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        sets = lambda x: np.unique(np.concatenate([np.zeros(0, np.int64), *(canonical(s, k) for s in x.as_py())]))
        return pa.array([len(np.intersect1d(sets(a), sets(b), assume_unique=True)) for a, b in zip(left, right, strict=True)], pa.int64())

    q, t = (texts.select(F.col("id").alias(c), F.col("seqs").alias(f"__{c}")) for c in ("query", "target"))
    return pairs.join(q, "query").join(t, "target").withColumn("shared", count("__query", "__target")).drop("__query", "__target")


def near_classes(texts: DataFrame, near: Callable[[Column], Column], share: float, k: int, most_common: int = 1000) -> DataFrame:
    """(query, target) of the classes' pairs, query < target, for which ``near`` of the shared k-mers holds; it asks for ``share`` of the smaller set's.

    Buckets keep the pairs that share by chance to themselves.  What they give bounds a
    pair's number from both sides; where that leaves it open, the sequences are compared.
    """
    size, n = _kmers_within(texts, k)
    count = _buckets(texts, size, max(int(share * size / max(n, 1) / 2.001), 1))
    sets = texts.select(F.lit(0).alias("side"), "id", "seqs")
    pairs = _counted(_written(met(sets, count, False, share, k)), False, most_common)
    missed = F.floor(share * F.least("n_query", "n_target") / count + 1e-6)
    most = F.col("shared") + (count - F.col("buckets")) * missed
    pairs = _written(pairs.withColumn("sure", near(F.col("shared"))).where(F.col("sure") | near(most)))
    rest = pairs.where("NOT sure").drop("shared")
    return pairs.where("sure").select("query", "target").union(shared_by(rest, texts, k).where(near(F.col("shared"))).select("query", "target"))


def cluster_pairs(df: DataFrame, id_col: str, seq: str = "seq", k: int = 16, least_identity: float = 0.90, least_coverage: float = 0.8) -> DataFrame:
    """(src, dst) of similar sequences, src < dst: estimated identity and the share of the longer one."""
    of, texts = _lettered(df, id_col, seq, k)
    near = lambda shared: (identity(shared, F.least("n_query", "n_target"), k) >= least_identity) & (F.least("n_query", "n_target") >= least_coverage * F.greatest("n_query", "n_target"))
    found = near_classes(texts, near, least_identity**k, k)
    same = of.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class", "class")
    found = found.union(found.select("target", "query")).union(same)
    return members_of(found, of, of).where("query < target").select(F.col("query").alias("src"), F.col("target").alias("dst"))


def best_identity(queries: DataFrame, targets: DataFrame, id_col: str, seq: str = "seq", k: int = 16, least: float = 0.5, least_coverage: float = 0.19, most_common: int = 1000) -> DataFrame:
    """(query, max_id): each query's highest estimated identity; 0 without a hit of ``least`` whose shorter one is ``least_coverage`` of the longer one."""
    (of, own), (_, other) = _lettered(queries, id_col, seq, k), _lettered(targets, id_col, seq, k)
    size = _kmers_within(own, k)[0] + _kmers_within(other, k)[0]
    sets = own.select(F.lit(0).alias("side"), "id", "seqs").union(other.select(F.lit(1).alias("side"), "id", "seqs"))
    pairs = _counted(_written(met(sets, _buckets(own, size), True, k=k)), True, most_common)
    pairs = pairs.where(F.least("n_query", "n_target") >= least_coverage * F.greatest("n_query", "n_target"))
    best = pairs.groupBy(F.col("query").alias("class")).agg(F.max(identity(F.col("shared"), F.least("n_query", "n_target"), k)).alias("max_id"))
    best = of.join(best, "class").select(F.col("id").alias("query"), "max_id")
    return queries.select(F.col(id_col).alias("query")).join(best.where(F.col("max_id") >= least), "query", "left").withColumn("max_id", F.coalesce("max_id", F.lit(0.0)))


def best_hits(hits: DataFrame, query: str = "query") -> DataFrame:
    """(query, max_id, max_id_local): best identity at a query coverage of 0.8, and over 200 aligned letters; 0 if none."""
    whole, local = F.max(F.when(F.col("qcov") >= 0.8, F.col("fident"))), F.max(F.when(F.col("alnlen") >= 200, F.col("fident")))
    return hits.groupBy(query).agg(F.coalesce(whole, F.lit(0.0)).alias("max_id"), F.coalesce(local, F.lit(0.0)).alias("max_id_local"))
