"""Removal of repeated byte strings by a distributed, common-prefix-aware suffix merge sort.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes.  Not
all suffixes need sorting: of the grams (``length / 2`` bytes) in a string of ``length``
bytes the one with the smallest hash is its anchor, so equal strings have equal anchors at
equal places.

1. A scan finds the anchors.  Their grams' hashes are counted, and those that occur more
   than once go back to their documents as lists of places.  Equal hashes of one task are
   sent once, so that no gram is heavy.
2. The documents meet their lists.  An entry is the suffix at an anchor, ``length`` bytes
   of it, with the bytes before the anchor, nearest first.  Entries are sorted, and equal
   ones of a task are one: they are repeated already.
3. What is left goes to the buckets of the grams as front-coded runs: the length of the
   prefix shared with the entry before, then the rest.
4. Runs are merged by a loser tree whose matches are decided by the known common prefixes,
   and compared from there on only if those are equal.  Entries that share the gram are a
   group; within it, the shared bytes after and before the anchors give the strings.

Where a gram is very common, entries at more places with a longer gram and fewer bytes
before stand for its anchor (``widths``), up to every string on its own.  They are sorted,
front-coded and merged like all others; the groups are finer and the results the same.

In a stretch of period p, p below a gram's length, each p bytes have an anchor.  If it is
``length + p`` bytes long, each of its strings repeats the one p bytes on, so the stretch
goes as a whole; of its anchors only those near its ends are needed, for strings that reach
beyond it and, once each, for those within it (``runs``, ``stretches``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import shingles
from strandline.llm.bitmaps import bitmap, is_set
from strandline.llm.shared import NO_ID, fresh, lean, partitions, written
from strandline.llm.shared import strings as values
from strandline.llm.shingles import mix

#: From so many occurrences of a gram on, its entries are of the next level.
LEVELS = (1024, 1 << 20)
CHUNK = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: A task sends what it has after so many anchors, or bytes of entries.
FLUSH_ANCHORS, FLUSH_BYTES = 250_000, 12 << 20
#: Entries whose groups are settled together, spans sent together, and the largest group that is settled by pairs.
TOGETHER, SPANS, PAIRED = 4096, 50_000, 48
RUN, SPAN = 0, 1


def widths(length: int) -> tuple[int, int, int]:
    """How many bytes before its place an entry of each level has."""
    return length - length // 2, max(length // 16, 1), 0


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each position on."""
    power, inverse = shingles._powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * inverse[: len(prefix) - n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are the smallest of a string of ``length`` bytes; the last of equal ones."""
    gram, places, found = length // 2, [], []
    width = length - gram + 1
    for lo in range(0, max(len(data) - length + 1, 0), CHUNK - length + 1):
        h = gram_hashes(data[lo : lo + CHUNK], gram)
        if len(h) < width:
            break
        value = (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))
        blocks = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        blocks[: len(h)] = value
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: len(h) - width + 1], ahead[width - 1 : len(h)])
        at = np.unique((PLACE - (least[np.concatenate([[True], least[1:] != least[:-1]])] & PLACE)).astype(np.int64))
        places.append(at + lo)
        found.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(found)[first]


def runs(data: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> np.ndarray:
    """Which anchors to keep: all but those inside of a stretch that repeats itself.

    Of anchors a, a + p, a + 2p ... with equal grams and p below a gram's length, a string
    whose anchor is ``gram + p`` bytes and more from both ends lies within the stretch, and
    is equal to one that begins in the first p bytes, whose anchor stays.
    """
    gram, keep = length // 2, np.ones(len(at), bool)
    step = np.diff(at)
    alike = (h[1:] == h[:-1]) & (step < gram)
    # chains of equal steps
    on = np.flatnonzero(np.concatenate([[False], alike[1:] & alike[:-1] & (step[1:] == step[:-1])]))
    for chain in np.split(on, np.flatnonzero(np.diff(on) != 1) + 1):
        if not len(chain):
            continue
        lo, hi = int(chain[0]) - 1, int(chain[-1]) + 1
        p, a, b = int(step[lo]), int(at[lo]), int(at[hi]) + gram
        inside = slice(*np.searchsorted(at, [a + gram + p + 1, b - gram - p]).tolist())
        if inside.start < inside.stop and np.array_equal(data[a : b - p], data[a + p : b]):
            keep[inside] = False
    return keep


def stretches(data: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches around equal anchors that repeat themselves and are long enough that all of them goes."""
    gram, out, ends = length // 2, [], {}
    step = np.diff(at)
    for i in np.flatnonzero((h[1:] == h[:-1]) & (step < gram)).tolist():
        p, a = int(step[i]), int(at[i])
        if a < ends.get(p, 0):
            continue
        start, end = a, a + p
        while end < len(data):  # on, in blocks, as long as each byte is the one p before
            n = min(len(data) - end, 1 << 16)
            other = np.flatnonzero(data[end : end + n] != data[end - p : end - p + n])
            end += int(other[0]) if len(other) else n
            if len(other):
                break
        while start > 0:
            n = min(start, 1 << 16)
            other = np.flatnonzero(data[start - n : start] != data[start - n + p : start + p])
            start -= n - 1 - int(other[-1]) if len(other) else n
            if len(other):
                break
        ends[p] = end
        if end - start >= length + p:
            out.append((start, end))
    return out


def joined(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same owner that touch are one; sorted."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    # owners' ends are kept apart by adding more than any end holds
    far = (np.cumsum(first) - 1) * (int(end.max()) + 1)
    most = np.maximum.accumulate(end + far)
    new = np.flatnonzero(first | np.concatenate([[True], start[1:] + far[1:] > most[:-1]]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    return owner[new], start[new], most[last] - far[last]


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes needn't be looked at."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        half = (lo + hi) // 2
        if a[lo:half] == b[lo:half]:
            lo = half
        else:
            hi = half
    return lo


class LoserTree:
    """Merges sorted runs of (prefix shared with the item before, string, payload).

    ``known[i]`` is the prefix that run i's head shares with the string that came out last.
    The head with the longer one is smaller; only equal ones are compared, beyond it.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]) -> None:
        self.runs, k = runs, max(len(runs), 1)
        self.size = 1 << (k - 1).bit_length()
        self.heads: list[tuple[bytes, object] | None] = [None] * self.size
        self.known = [0] * self.size
        for i in range(len(runs)):
            self._advance(i)
        self.known = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _advance(self, i: int) -> None:
        head = next(self.runs[i], None)
        self.heads[i] = None if head is None else head[1:]
        self.known[i] = 0 if head is None else head[0]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        p, q = self.known[a], self.known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common(x[0], y[0], p)
        if x[0][n : n + 1] <= y[0][n : n + 1]:
            self.known[b] = n
            return a, b
        self.known[a] = n
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.losers[node] = self._match(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(prefix shared with the string before, string, payload), ascending."""
        while (head := self.heads[self.winner]) is not None:
            i = self.winner
            yield self.known[i], *head
            self._advance(i)
            node = (i + self.size) >> 1
            while node:
                i, self.losers[node] = self._match(i, self.losers[node])
                node >>= 1
            self.winner = i


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(shared, length of the rest) of each of some sorted strings, and the rests."""
    before, codes, rest = b"", [], []
    for s in strings:
        n = common(before, s, 0)
        codes.append((n, len(s) - n))
        rest.append(s[n:])
        before = s
    return np.array(codes, "<u2").reshape(-1, 2), b"".join(rest)


def decoded(codes: np.ndarray, rest: bytes) -> Iterator[tuple[int, bytes]]:
    before, at = b"", 0
    for n, m in codes.tolist():
        before = before[:n] + rest[at : at + m]
        at += m
        yield n, before


class Groups:
    """Settles groups of entries that come in sorted order; ``spans`` holds (entry, least, most) of what is repeated.

    An entry's number names it; its string is a level's byte, the bytes after its place
    and those before, reversed.  Of ``after[i]`` bytes after and the rest before, a string
    of ``length`` bytes begins ``least`` to ``most`` bytes before the place.
    """

    def __init__(self, after: np.ndarray, settled: np.ndarray, length: int) -> None:
        self.after, self.settled, self.length = after, settled, length
        self.gram = [1 + length - w for w in widths(length)]
        self.spans: list[tuple[int, int, int]] = []
        self._clear()

    def _clear(self) -> None:
        self.shared: list[int] = []
        self.strings: list[bytes] = []
        self.entry: list[int] = []
        self.done: list[bool] = []

    def add(self, shared: int, string: bytes, i: int) -> None:
        """The next entry, and the prefix that it shares with the one before."""
        if self.strings:
            if shared == len(string) == len(self.strings[-1]) and self.after[i] == self.after[self.entry[-1]]:
                if not self.done[-1]:
                    self.done[-1] = True
                    self._whole(self.entry[-1], string)
                self._whole(i, string)
                return
            if shared < self.gram[string[0]] and len(self.strings) >= TOGETHER:
                self.settle()
                shared = 0
        self.shared.append(shared if self.strings else 0)
        self.strings.append(string)
        self.entry.append(i)
        self.done.append(bool(self.settled[i]))

    def _whole(self, i: int, string: bytes) -> None:
        n = int(self.after[i])
        if not self.settled[i] and len(string) - 1 >= self.length:
            self.spans.append((i, self.length - n, len(string) - 1 - n))

    def settle(self) -> None:
        if not self.strings:
            return
        entry, shared = np.array(self.entry), np.array(self.shared)
        after = self.after[entry].astype(np.int64)
        before = np.array([len(s) for s in self.strings]) - 1 - after
        gram = np.array(self.gram)[[s[0] for s in self.strings]]
        width = max(int(before.max()), 1)
        left = np.frombuffer(b"".join([s[1 + n :].ljust(width, b"\0") for s, n in zip(self.strings, after.tolist(), strict=True)]), np.uint8).reshape(-1, width)
        starts = np.flatnonzero(shared < gram)
        sizes = np.diff(starts, append=len(shared))
        paired = np.repeat(sizes <= PAIRED, sizes)
        least, most = by_pairs(shared - 1, after, before, left, np.repeat(starts, sizes), paired, self.length)
        for lo, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist(), strict=True):
            at = slice(lo, lo + n)
            least[at], most[at] = by_depth(shared[at] - 1, after[at], before[at], left[at], self.length)
        found = np.flatnonzero((least <= most) & ~np.array(self.done))
        self.spans += zip(entry[found].tolist(), least[found].tolist(), most[found].tolist(), strict=True)
        self._clear()


def by_pairs(shared: np.ndarray, after: np.ndarray, before: np.ndarray, left: np.ndarray, group: np.ndarray, chosen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) of the chosen entries: each with each of its group.  least > most where nothing is repeated."""
    n = len(shared)
    least, most = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    i = np.flatnonzero(chosen[:-1] & (group[1:] == group[:-1]))
    common = shared[i + 1]
    step = 1
    while len(i):
        j = i + step
        same = left[i] == left[j]
        back = np.where(same.all(1), left.shape[1], same.argmin(1))
        back = np.minimum(back, np.minimum(before[i], before[j]))
        low = np.maximum(length - np.minimum(common, np.minimum(after[i], after[j])), 0)
        ok = low <= back
        for x in (i[ok], j[ok]):
            np.minimum.at(least, x, low[ok])
            np.maximum.at(most, x, back[ok])
        step += 1
        on = i + step < n
        i, common = i[on], common[on]
        on = group[i + step] == group[i]
        i = i[on]
        common = np.minimum(common[on], shared[i + step])
    return least, most


def by_depth(shared: np.ndarray, after: np.ndarray, before: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one large group: a string that begins d bytes before is known by the class of the d bytes before and that of the others after.

    Classes change at the common prefixes of neighbours only, so few d are looked at.
    """
    n = len(shared)
    least, most = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    order = np.lexsort((before, *left.T[::-1]))
    rows = left[order]
    same = rows[1:] == rows[:-1]
    back = np.where(same.all(1), left.shape[1], same.argmin(1))
    back = np.minimum(back, np.minimum(before[order][1:], before[order][:-1]))
    turns = np.unique(np.concatenate([[0], back + 1, before + 1, length - shared[1:], length - after]))
    turns = turns[(turns >= 0) & (turns <= int(before.max()))]
    for d, last in zip(turns.tolist(), [*(turns[1:] - 1).tolist(), int(before.max())], strict=True):
        ahead = np.cumsum(np.concatenate([[0], shared[1:] < length - d]))
        behind = np.empty(n, np.int64)
        behind[order] = np.cumsum(np.concatenate([[0], back < d]))
        valid = np.flatnonzero((before >= d) & (after >= length - d))
        if len(valid) < 2:
            continue
        _, where, count = np.unique(ahead[valid] * n + behind[valid], return_inverse=True, return_counts=True)
        hit = valid[count[where] > 1]
        least[hit] = np.minimum(least[hit], d)
        most[hit] = np.maximum(most[hit], last)
    return least, most


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _packed(at: np.ndarray, h: np.ndarray) -> bytes:
    return at.astype("<u8").tobytes() + h.astype("<u8").tobytes()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in values(column.cast(pa.binary())):
        yield text or b""


def repeated_anchors(rows: DataFrame, length: int, levels: tuple[int, int]) -> DataFrame:
    """Of rows (id, th, text): (id, th, at) with places and hashes of the anchors whose gram's hash occurs more than once, and (hot, level) of the common ones."""
    count = 1 << max(partitions(rows, 8) - 1, 1).bit_length()
    last = np.uint64(count - 1)  # anchors' hashes are small ones: only their last bits are even
    names = ["bucket", "id", "th", "at", "asked", "told", "h", "n", "owners"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        owners, held, size = [], [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            at, h = (np.concatenate(x) for x in zip(*held, strict=True))
            who = np.repeat(np.arange(len(owners)), [len(x[0]) for x in held])
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.diff(first, append=len(s))
            known = np.zeros(len(h), bool)  # repeated within what this task holds
            known[order] = np.repeat(n > 1, n)
            out = []
            cuts = np.searchsorted(who, np.arange(len(owners) + 1))
            for w in np.unique(who[known]).tolist():
                mine = slice(cuts[w], cuts[w + 1])
                out.append((w % count, *owners[w], _packed(at[mine][known[mine]], h[mine][known[mine]]), None, None, None, None, None))
            one, rep = s[first], order[first]
            bucket = (one & last).astype(np.int64)
            # within a bucket those that ask, of one place, come first
            order = np.lexsort((n > 1, bucket))
            one, rep, n, bucket = one[order], rep[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(one)], strict=True):
                ask = int((n[lo:hi] == 1).sum())
                mine = rep[lo : lo + ask]
                used, local = np.unique(who[mine], return_inverse=True)
                told = local.astype("<u4").tobytes() + at[mine].astype("<u8").tobytes()
                owner = np.array([owners[u] for u in used.tolist()], "<i8").tobytes()
                out.append((int(bucket[lo]), None, None, None, ask, told, one[lo:hi].tobytes(), n[lo + ask : hi].astype("<u4").tobytes(), owner))
            yield _batch(names, kinds, out)

        for batch in batches:
            for key, th, text in zip(*map(values, batch.columns[:2]), _texts(batch.column(2)), strict=True):
                data = np.frombuffer(text, np.uint8)
                at, h = anchors(data, length)
                if len(at):
                    keep = runs(data, at, h, length)
                    at, h = at[keep], h[keep]
                    owners.append((key, th))
                    held.append((at, h))
                    size += len(at)
                if size >= FLUSH_ANCHORS:
                    yield from flushed()
                    owners, held, size = [], [], 0
        if held:
            yield from flushed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[tuple] = []
        now = None
        names = ["id", "th", "at", "hot", "level"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]

        def added() -> Iterator[pa.RecordBatch]:
            hashes = [np.frombuffer(x[2], "<u8") for x in held]
            h = np.concatenate(hashes)
            n = np.concatenate([np.concatenate([np.ones(x[0], np.int64), np.frombuffer(x[3], "<u4")]) for x in held])
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total = np.add.reduceat(n[order], first)
            several = np.zeros(len(h), bool)
            several[order] = np.repeat(total > 1, np.diff(first, append=len(s)))
            out = [(None, None, None, x, 1 + (c >= levels[1])) for x, c in zip(s[first][total >= levels[0]].view(np.int64).tolist(), total[total >= levels[0]].tolist(), strict=True)]
            base = 0
            for (ask, told, _, _, owner), own in zip(held, hashes, strict=True):
                hit = np.flatnonzero(several[base : base + ask])
                base += len(own)
                if len(hit):
                    local, at = np.frombuffer(told, "<u4", ask)[hit].astype(np.int64), np.frombuffer(told, "<u8", ask, 4 * ask)[hit]
                    who = np.frombuffer(owner, "<i8").reshape(-1, 2)
                    order = np.argsort(local, kind="stable")
                    cuts = np.flatnonzero(np.diff(local[order], prepend=-1))
                    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                        mine = order[lo:hi]
                        out.append((*who[local[mine[0]]].tolist(), _packed(at[mine], own[hit[mine]]), None, None))
            if out:
                yield _batch(names, kinds, out)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                plain = []
                for bucket, key, th, at, *rest in zip(*(c.slice(lo, 64).to_pylist() for c in batch.columns), strict=True):
                    if bucket != now and held:
                        yield from added()
                        held = []
                    now = bucket
                    if at is None:
                        held.append(rest)
                    else:
                        plain.append((key, th, at, None, None))
                if plain:
                    yield _batch(names, kinds, plain)
        if held:
            yield from added()

    found = rows.mapInArrow(scan, "bucket int, id long, th long, at binary, asked long, told binary, h binary, n binary, owners binary")
    return found.repartition(partitions(rows, 8), "bucket").sortWithinPartitions("bucket").mapInArrow(add, "id long, th long, at binary, hot long, level int")


def places(at: np.ndarray, level: np.ndarray, size: int, length: int) -> list[tuple[int, int]]:
    """(place, level) of the entries that stand for anchors of these places and levels, each once."""
    wide, narrow, _ = widths(length)
    out = [(int(p), 0) for p in at[level == 0]]
    if (level == 1).any():
        q = (at[level == 1][:, None] - np.arange(0, wide, narrow)[None]).ravel()
        out += [(int(p), 1) for p in np.unique(q[(q >= 0) & (q + length - narrow <= size)])]
    if (level == 2).any():
        q = (at[level == 2][:, None] - np.arange(wide + 1)[None]).ravel()
        out += [(int(p), 2) for p in np.unique(q[(q >= 0) & (q + length <= size)])]
    return out


def repeated_spans(rows: DataFrame, lists: DataFrame, hot: DataFrame, length: int, id_col: str, th_col: str, text_col: str) -> DataFrame:
    """(id, th, start, end): bytes to remove, in any order.

    Rows have the lists of ``repeated_anchors`` in the column ``lists`` already.
    """
    spark = rows.sparkSession
    bounds = [bitmap(written(hot.where(F.col("level") >= n).select(F.col("hot").alias("h")), "hot"), 27) for n in (1, 2)]
    shared = spark.sparkContext.broadcast(bounds)  # 16 MB each at most
    parts = partitions(rows, 4)
    count = 1 << max(parts - 1, 1).bit_length()
    wide = widths(length)
    names = ["bucket", "kind", "id", "th", "start", "end", "codes", "rest", "owners"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        (hot, bits), (hottest, most_bits) = shared.value
        zipper = zstandard.ZstdCompressor(level=1)
        entries: list[tuple[int, bytes, int, int, int, int]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            whole = [x for x in entries if not x[1]]
            out, lo = [(bucket, SPAN, key, th, *span, None, None, None) for bucket, _, _, key, th, span in whole], 0
            entries[:] = [x for x in entries if x[1]]
            entries.sort()
            while lo < len(entries):
                bucket, strings, owner = entries[lo][0], [], []
                while lo < len(entries) and entries[lo][0] == bucket:
                    _, s, n, key, th, q = entries[lo]
                    hi = lo + 1
                    while hi < len(entries) and entries[hi][:3] == entries[lo][:3]:
                        hi += 1
                    if hi > lo + 1 and len(s) - 1 >= length:
                        out += [(q % count, SPAN, key, th, q + n + 1 - len(s), q + n, None, None, None) for _, _, _, key, th, q in entries[lo:hi]]
                    strings.append(s)
                    owner.append((key, th, q, n, hi > lo + 1))
                    lo = hi
                codes, rest = front_coded(strings)
                out.append((bucket, RUN, None, None, None, None, codes.tobytes(), zipper.compress(rest), zipper.compress(np.array(owner, "<i8").T.tobytes())))
            yield _batch(names, kinds, out)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (id_col, th_col, "lists")]
            for key, th, lists, raw in zip(*map(values, columns), _texts(batch.column(batch.schema.get_field_index(text_col))), strict=True):
                both = np.concatenate([np.frombuffer(x, "<u8").reshape(2, -1) for x in lists], axis=1)
                at, first = np.unique(both[0].astype(np.int64), return_index=True)
                h = both[1][first]
                entries += [(zlib.crc32(b"%d" % a) & (count - 1), b"", 0, key, th, (a, b)) for a, b in stretches(np.frombuffer(raw, np.uint8), at, h, length)]
                level = is_set(hot, h, bits).astype(np.int64)
                level[level > 0] += is_set(hottest, h[level > 0], most_bits)
                for q, v in places(at, level, len(raw), length):
                    right, w = raw[q : q + length], wide[v]
                    bucket = zlib.crc32(right[: length - w]) & (count - 1)
                    entries.append((bucket, bytes([v]) + right + raw[max(q - w, 0) : q][::-1], len(right), key, th, q))
                    size += 200 + len(entries[-1][1])
                    if size >= FLUSH_BYTES:
                        yield from sent()
                        entries, size = [], 0
        if entries:
            yield from sent()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        unzip = zstandard.ZstdDecompressor()
        runs: list[tuple[bytes, bytes, bytes]] = []
        now = None

        def spans(key: list, th: list, start: list, end: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (key, th, start, end)], names=["id", "th", "start", "end"])

        def merged() -> Iterator[pa.RecordBatch]:
            owner = np.concatenate([np.frombuffer(unzip.decompress(x[2]), "<i8").reshape(5, -1) for x in runs], axis=1)
            key, th, place, after, settled = owner
            groups = Groups(after, settled, length)

            def told() -> pa.RecordBatch:
                i, least, most = np.array(groups.spans, np.int64).T
                groups.spans = []
                who, of = np.unique(np.stack([key[i], th[i]], 1), axis=0, return_inverse=True)
                of, start, end = joined(of.ravel(), place[i] - most, place[i] + length - least)
                return spans(who[of, 0], who[of, 1], start, end)

            iterators, base = [], 0
            for codes, rest, _ in runs:
                code = np.frombuffer(codes, "<u2").reshape(-1, 2)
                iterators.append(_numbered(code, rest, base, unzip))
                base += len(code)
            for n, s, i in LoserTree(iterators):
                groups.add(n, s, i)
                if len(groups.spans) >= SPANS:
                    yield told()
            groups.settle()
            if groups.spans:
                yield told()

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                plain = []
                for bucket, kind, key, th, start, end, *run in zip(*(c.slice(lo, 64).to_pylist() for c in batch.columns), strict=True):
                    if bucket != now and runs:
                        yield from merged()
                        runs = []
                    now = bucket
                    if kind == SPAN:
                        plain.append((key, th, start, end))
                    else:
                        runs.append(tuple(run))
                if plain:
                    yield spans(*zip(*plain, strict=True))
        if runs:
            yield from merged()

    sent = rows.mapInArrow(scan, "bucket int, kind int, id long, th long, start long, end long, codes binary, rest binary, owners binary")
    return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "id long, th long, start long, end long")


def merged_spans(spans: DataFrame, id_col: str, th_col: str, name: str) -> DataFrame:
    """(id, th, ``name``): each document's intervals, those that touch as one, as pairs of longs.

    The rows of a document come sorted and are merged as they come: what is held is the
    merged intervals of one document.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, held = None, []

        def told() -> tuple:
            return (*now, np.concatenate(held).astype("<i8").tobytes())

        for batch in batches:
            key, th, start, end = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (th[1:] != th[:-1])])) if len(key) else []
            out = []
            for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
                mine = (int(key[lo]), int(th[lo]))
                if now is not None and mine != now:
                    out.append(told())
                    held = []
                now = mine
                _, a, b = joined(np.zeros(hi - lo, np.int64), start[lo:hi], end[lo:hi])
                part = np.stack([a, b], 1)
                if held and a[0] <= held[-1][-1, 1]:
                    _, a, b = joined(np.zeros(len(part) + 1, np.int64), np.append(held[-1][-1, 0], a), np.append(held[-1][-1, 1], b))
                    part, held[-1] = np.stack([a, b], 1), held[-1][:-1]
                held.append(part)
            if out:
                yield _batch(["id", "th", "spans"], [pa.int64(), pa.int64(), pa.binary()], out)
        if now is not None:
            yield _batch(["id", "th", "spans"], [pa.int64(), pa.int64(), pa.binary()], [told()])

    dealt = spans.repartition(partitions(spans), "id", "th").sortWithinPartitions("id", "th", "start")
    return dealt.mapInArrow(merge, "id long, th long, spans binary").select(F.col("id").alias(id_col), F.col("th").alias(th_col), F.col("spans").alias(name))


def _numbered(code: np.ndarray, rest: bytes, base: int, unzip: zstandard.ZstdDecompressor) -> Iterator[tuple[int, bytes, int]]:
    for i, (n, s) in enumerate(decoded(code, unzip.decompress(rest)), base):
        yield n, s, i


@F.arrow_udf(T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())]))
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    lean()
    kept, size, removed, runs = [], [], [], []
    for t, s in zip(values(text), values(spans), strict=True):
        data, at, out, n = (t or "").encode("utf-8", "surrogatepass"), 0, [], 0
        for start, end in np.frombuffer(s, "<i8").reshape(-1, 2).tolist() if s else []:
            out.append(data[at:start])
            n += 1
            at = end
        out.append(data[at:])
        kept.append(b"".join(out))
        size.append(len(data))
        removed.append(len(data) - len(kept[-1]))
        runs.append(n)
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, removed, runs))], names=["kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, length: int = 400, levels: tuple[int, int] = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A null text is empty.  Rows with the same or a null id are documents of their own: if
    their texts are equal and long enough, each repeats the other.  Of equal strings none
    is kept.  Columns named like the new ones are replaced; all others, the text too, are
    as they were.  A text of any length is one value: a task holds it, the hashes of a
    part of it, and the places of its repeated anchors.  No rows give no rows.
    """
    key, th = fresh(docs, "id"), fresh(docs, "th")
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), th: F.xxhash64(F.col(text_col).cast("string"))})
    rows = keyed.select(F.col(key).alias("id"), F.col(th).alias("th"), F.col(text_col).cast("string").alias("text"))
    found = written(repeated_anchors(rows, length, levels), "anchors")
    # with no other columns, one exchange of the documents serves both joins
    dealt = keyed.repartition(partitions(docs), key, th)
    own = found.where("at IS NOT NULL").groupBy(F.col("id").alias(key), F.col("th").alias(th)).agg(F.collect_list("at").alias("lists"))
    used = keyed.columns if {*docs.columns} <= {id_col, text_col} else [key, th, text_col]
    listed = dealt.join(own.hint("shuffle_hash"), [key, th]).select(*used, "lists").withColumn(text_col, F.col(text_col).cast("string"))
    spans = repeated_spans(listed, own, found.where("level IS NOT NULL").select("hot", "level"), length, key, th, text_col)
    runs, cut = fresh(docs, "runs"), fresh(docs, "cut")
    spans = merged_spans(spans, key, th, runs)
    out = dealt.join(spans.hint("shuffle_hash"), [key, th], "left").withColumn(cut, _cut(F.col(text_col).cast("string"), runs))
    return out.withColumns({c: F.col(f"{cut}.{c}") for c in ("kept", "n_bytes", "n_removed", "n_spans")}).drop(key, th, runs, cut)
