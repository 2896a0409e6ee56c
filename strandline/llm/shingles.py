"""Hashed word shingles of whole texts.

Words are runs of bytes other than space and 0x09-0x0D, after A-Z went to lower case.
A word's hash is a polynomial in its bytes, found as a difference of prefix sums; a
shingle's is a polynomial in its words' hashes.  Texts are hashed in parts of bounded
size, and a word that lies in several parts is carried on, so that a text needs little
memory beside its own bytes and eight bytes a word.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at a time.
PART_BYTES = 1 << 18
LENGTH, NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    global _POWERS, _INVERSES
    while len(_POWERS) < n:
        step, back = pow(BASE, len(_POWERS), 1 << 64), pow(pow(BASE, -1, 1 << 64), len(_POWERS), 1 << 64)
        _POWERS = np.concatenate([_POWERS, _POWERS * np.uint64(step)])
        _INVERSES = np.concatenate([_INVERSES, _INVERSES * np.uint64(back)])
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose result bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, cased: bool = False) -> np.ndarray:
    """A hash of each word, in order; ``cased`` tells A-Z and a-z apart."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw if cased else raw.lower(), np.uint8)
    power, inverse = _powers(min(len(data), PART_BYTES) + 1)
    found: list[np.ndarray] = []
    held: tuple[int, int] | None = None  # hash and length of a word that goes on in the next part
    for lo in range(0, len(data), PART_BYTES):
        part = data[lo : lo + PART_BYTES]
        word = (part != 32) & (part - np.uint8(9) > 4)
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=prefix[1:])
        h, n = (prefix[ends] - prefix[starts]) * inverse[starts], (ends - starts).astype(np.uint64)
        if held is not None:
            if word[0]:
                h[:1] = h[:1] * np.full(1, pow(BASE, held[1], 1 << 64), np.uint64) + np.full(1, held[0], np.uint64)
                n[:1] += np.uint64(held[1])
            else:
                found.append(mix(np.full(1, held[0], np.uint64) + np.full(1, held[1], np.uint64) * LENGTH))
            held = None
        if word[-1] and lo + PART_BYTES < len(data):
            held, h, n = (int(h[-1]), int(n[-1])), h[:-1], n[:-1]
        found.append(mix(h + n * LENGTH))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def hashes(text: str | None, k: int = 5) -> np.ndarray:
    """A hash for each run of k words, in order; of fewer words, one for all of them; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out *= NEXT
        out += w[j : j + len(out)]
    return mix(out)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(hashes(text, k))
