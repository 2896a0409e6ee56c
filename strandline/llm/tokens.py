"""Token ids by the tokenizers library, through a bounded cache of text pieces.

The library applies its merges to one pre-token at a time.  A text is therefore cut
at places that are pre-token boundaries in any context, every distinct piece is
encoded once by the library, and the ids of the pieces are strung together.  Texts
with irregular white space, for which the cut would need more care, are encoded
whole.  Both ways give the library's own ids; ``tests/llm`` compares them.
"""

from __future__ import annotations

import itertools
import os
import string
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Distinct pieces kept by a worker; the cache starts afresh beyond it.
CACHE_PIECES = 250_000
#: Longer pieces are encoded each time, so that the cache's memory is bounded.
CACHE_PIECE_CHARS = 64


class Encoder:
    """``encode(texts)`` gives one uint32 array of ids for each text.

    ``mode`` says where a text may be cut: ``"byte"`` for byte-level vocabularies whose
    words carry their leading space, ``"word"`` for vocabularies that drop white space,
    ``None`` for no cutting at all.
    """

    def __init__(self, path: str, mode: str | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.mode = mode
        self.between, self.opens, self.words = -1, np.zeros(0, bool), False
        if mode:
            # no word is a token of its own, so that the model alone decides on words
            self.words = not any(t.content.strip().isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
            self.model = self.tokenizer.model
            spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.spelling = {c: spell(chr(c))[0][0] for c in range(0x80, 0x250)}
            self.between = self._library(["\x02"])[0][0]
            vocab = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for t, i in vocab.items() if t[0] in "\u0120\u010a"]] = True  # how byte-level files spell space and line feed
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.hits = np.zeros(1 << 14, np.int64)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _thin(self) -> None:
        """Keeps what was asked for more than twice, half of the cache at most."""
        kept = np.flatnonzero(self.hits[: len(self.index)] > 2)[: CACHE_PIECES // 2]
        pieces, chosen = [], {*kept.tolist()}
        pieces = [p for p, n in self.index.items() if n in chosen]
        old = np.fromiter((self.index[p] for p in pieces), np.int64, len(pieces))
        lengths, starts, flat = self.lengths[old], self.starts[old], self.flat
        self._reset()
        self.index.update(zip(pieces, range(len(pieces)), strict=True))
        ends = np.cumsum(lengths)
        if len(pieces):
            self._store(pieces, flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])], ends - lengths)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all pieces, from one library call, and where each piece's begin.

        Byte level: a piece begins with its only space or line feed, and so does its first
        token.  Words: a token that no piece has stands before each piece.  None if the
        parts don't add up.
        """
        if self.mode == "byte":
            ids = np.asarray(self._library(["".join([self._spelled(p) for p in pieces])])[0], np.uint32)
            at = np.flatnonzero(self.opens[ids])
            return (ids, at) if len(at) == len(pieces) and at[0] == 0 else None
        ids = np.asarray(self._library(["\x02 " + " \x02 ".join(pieces)])[0], np.uint32)
        at = np.flatnonzero(ids == self.between)
        return (np.delete(ids, at), at - np.arange(len(at))) if len(at) == len(pieces) else None

    def _store(self, pieces: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.index) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        numbers = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + at
        self.lengths[numbers] = np.diff(at, append=len(ids))
        self.used += len(ids)

    def _whole_words(self, words: list[str]) -> None:
        """Single words below U+0250: normalization leaves them as they are, and one is one pre-token."""
        tokenize, opening, spelling = self.model.tokenize, "\u0120" if self.mode == "byte" else "", self.spelling
        coded = [[t.id for t in tokenize(opening + (w if w.isascii() else w.translate(spelling)))] for w in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self._store(words, np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(lengths.sum())), np.cumsum(lengths) - lengths)

    def _one_by_one(self, pieces: list[str]) -> None:
        coded = self._library([self._spelled(p) for p in pieces])
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self._store(pieces, np.fromiter((i for ids in coded for i in ids), np.uint32, int(lengths.sum())), np.cumsum(lengths) - lengths)

    def _look_up(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers; -1 for new ones."""
        return np.fromiter(map(self.index.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))

    def _add(self, new: list[str]) -> np.ndarray:
        """Encodes new pieces, each named once; their numbers."""
        base = len(self.index)
        self.index.update(zip(new, range(base, base + len(new)), strict=True))
        if new:
            self._learn(new)
        return np.arange(base, base + len(new))

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces.  A word with punctuation after it is two pre-tokens, and both are known sooner."""
        index, mark, byte, words = self.index, "\x00" if self.mode == "byte" else "", self.mode == "byte", self.words
        simple, rest, alone, ended, parts = [], [], [], [], []

        def odd(p: str) -> None:
            (alone if "\x00" in p or "\x02" in p or not p else rest).append(p)

        def plain(p: str) -> bool:
            # letters below U+0250 are left as they are by normalization; capitals only by byte level
            return words and (p.isascii() or (max(p) < "\u0250" and (byte or p.islower())))

        def number(p: str) -> int:
            if (n := index.get(p)) is None:
                n = index[p] = len(index)
                simple.append(p) if p.isalpha() and plain(p) else odd(p)
            return n

        for p in new:
            if p.isalpha():
                simple.append(p) if plain(p) else odd(p)
            elif (word := p.rstrip(string.punctuation)) != p and word.isalpha():
                ended.append(p)
                parts += (number(word), number(mark + p[len(word) :]))
            else:
                odd(p)
        if simple:
            self._whole_words(simple)
        for i in range(0, len(rest), 256):
            if found := self._joined(part := rest[i : i + 256]):
                self._store(part, *found)
            else:
                self._one_by_one(part)
        if alone:
            self._one_by_one(alone)
        if ended:
            at = np.array(parts, np.int64)
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            ids = self.flat[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(ends[-1])]
            self._store(ended, ids, (ends - lengths)[::2])

    def _spelled(self, piece: str) -> str:
        """The text that a piece stands for: a text's first word has no space before it."""
        if self.mode == "word":
            return piece
        return piece[1:] if piece[0] == "\x00" else piece if piece[0] == "\n" else " " + piece

    def _split(self, column: pa.Array) -> pa.ListArray:
        """The pieces of each text, whose ids, strung together, are the text's unless ``_barred`` says otherwise."""
        if self.mode == "word":
            # A-Z only: the vocabulary has no capitals
            return pc.split_pattern(pc.replace_substring(pc.ascii_lower(column), "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")

    def _barred(self, piece: str) -> bool:
        """Whether a text that has this piece must be encoded whole."""
        if len(piece) > CACHE_PIECE_CHARS:
            return True
        if self.mode == "word":
            return False
        # white space at a piece's begin: the cut before it lies inside a run of white space
        return not piece or piece == "\n" or "\x00" in piece or (piece[1:2].isspace() if piece[0] == "\n" else piece[0].isspace())

    def encode(self, texts: Iterable[str] | pa.Array) -> list[np.ndarray]:
        """One array of ids a text; an Arrow column has no nulls."""
        if isinstance(texts, pa.Array):
            # a copy: Arrow's lower-casing reads past a slice that begins after its buffer does
            texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        else:
            texts = pa.array(list(texts), pa.large_string())
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        whole = range(len(texts)) if self.mode is None else self._encode_pieces(texts, out)
        for i, ids in zip(whole, self._library([texts[i].as_py() for i in whole]), strict=True):
            out[i] = np.asarray(ids, np.uint32)
        return out

    def _encode_pieces(self, texts: pa.Array, out: list[np.ndarray]) -> list[int]:
        """Fills ``out`` for the texts that may be cut, and returns the others' places."""
        if not len(texts):
            return []
        if len(self.index) > CACHE_PIECES:
            self._thin()
        lists = self._split(texts)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        pieces, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        index = self.index
        number = self._look_up(pieces)
        fresh = np.flatnonzero(number < 0)
        barred = np.zeros(len(pieces), bool)
        barred[fresh] = [self._barred(pieces[i]) for i in fresh.tolist()]
        bad = np.logical_or.reduceat(barred[codes], bounds[:-1])
        if self.mode == "byte":
            bad |= [not c or c.isspace() for c in pc.utf8_slice_codeunits(texts, -1).to_pylist()]
        if bad.any():
            known = np.zeros(len(pieces), bool)
            known[codes[np.repeat(~bad, np.diff(bounds))]] = True
            fresh = fresh[known[fresh]]
        number[fresh] = self._add([pieces[i] for i in fresh.tolist()])
        at = number[codes]
        if self.mode == "byte":
            good = np.flatnonzero(~bad)
            first, which = np.unique(codes[bounds[good]], return_inverse=True)
            opening = ["\x00" + pieces[c] for c in first.tolist()]
            numbers = self._look_up(opening)
            numbers[numbers < 0] = self._add([p for p, n in zip(opening, numbers.tolist(), strict=True) if n < 0])
            at[bounds[good]] = numbers[which]
        if len(self.hits) < len(index):
            self.hits = np.concatenate([self.hits, np.zeros(len(index), np.int64)])
        for lo in range(0, len(texts), 256):  # what is strung together at a time
            hi = min(lo + 256, len(texts))
            mine = at[bounds[lo] : bounds[hi]]
            lengths = np.where(np.repeat(bad[lo:hi], np.diff(bounds[lo : hi + 1])), 0, self.lengths[mine])
            n = np.bincount(mine[lengths > 0])
            self.hits[: len(n)] += n
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[mine] - ends + lengths, lengths)
            shift += np.arange(len(shift))
            ids = self.flat[shift]
            last = np.concatenate([[0], ends[bounds[lo + 1 : hi + 1] - bounds[lo] - 1]])
            for i in range(lo, hi):
                if not bad[i]:
                    out[i] = ids[last[i - lo] : last[i - lo + 1]].copy()
        return np.flatnonzero(bad).tolist()


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, mode: str | None = None) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = (path, mode)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, mode)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
