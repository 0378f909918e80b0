"""Texts as numbers of distinct words, for vocabularies with an end-of-word suffix.

A chunk is a white space character and what stands behind it up to the next one. Chunks met first are cut into
pre-tokens, which become numbers in a pool of words; texts become runs of these numbers by way of their
chunks. What a word is worth (a count, ids) is learned once a distinct word, by whoever uses the numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import pool, wordbpe

RUN_BYTES = 1 << 18

# Kinds of bytes. Small letters of two bytes behind C3 count as letters byte by byte.
_MARK, _LETTER, _DIGIT, _SPACE, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KIND[48:58], _KIND[9:14], _KIND[32], _KIND[ord("'")] = _DIGIT, _SPACE, _SPACE, _HARD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TextWords:
    """``learn`` gets words met first, in the order of their numbers; ``forget`` is called when the numbers start again."""

    def __init__(self, bpe: wordbpe.WordBPE, learn: Callable[[list[bytes]], None], forget: Callable[[], None], most: int):
        self.bpe, self.forget_words = bpe, forget
        self.words = pool.Pool(learn, lambda: None, 1 << 60)  # starts again with the chunks
        self.chunks = pool.Pool(self._learn, self._forget, most)
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.forget_words()
        self.first, self.size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.apart = np.zeros(1 << 15, bool)  # chunks whose words' hashes clash
        self.numbers = np.zeros(1 << 15, np.int32)
        self.used = self.n_numbers = 0

    def _keep(self, numbers: np.ndarray, sizes: np.ndarray, where: np.ndarray) -> None:
        """Runs of word numbers become those of the chunks ``where``."""
        n = self.n_numbers + len(numbers)
        if n > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros(n, np.int32)])
        self.numbers[self.n_numbers : n] = numbers
        self.first[where], self.size[where] = self.n_numbers + np.cumsum(sizes) - sizes, sizes
        self.n_numbers = n

    def _learn(self, pieces: list[bytes]) -> None:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        long = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(long) - long
        kind = _KIND[data]
        # big letters behind C3, the division mark among them, and other continuation bytes
        lead = np.append(False, data[:-1] == 0xC3)
        tail = (data >= 0x80) & (data != 0xC3)
        bad = (kind == _HARD) | (tail & (~lead | (data < 0x9F) | (data == 0xB7)))
        easy = np.ones(len(pieces), bool)
        easy[np.searchsorted(starts, np.flatnonzero(bad), "right") - 1] = False
        n = self.used + len(pieces)
        for k in ("first", "size", "apart"):
            old = getattr(self, k)
            if n > len(old):
                setattr(self, k, np.concatenate([old, np.zeros(n, old.dtype)]))
        own = np.repeat(np.arange(len(pieces)), long)
        before = np.append(_SPACE, kind[:-1])
        before[starts] = _SPACE
        word = (kind != before) | (kind == _DIGIT)
        solid = easy[own] & (kind != _SPACE)
        word, own = word[solid], own[solid]
        begins = np.flatnonzero(word)
        number, clash = self.words.find(_LOWER[data[solid]], begins)
        where = np.flatnonzero(easy)
        sizes = np.bincount(own[begins], minlength=len(pieces))[where] if len(begins) else np.zeros(len(where), np.int64)
        self._keep(number, sizes, self.used + where)
        self.apart[self.used + own[begins[clash]]] = True
        hard = np.flatnonzero(~easy)
        if len(hard):
            cut = [[w for c in self.bpe.chunks(pieces[k].decode()) for w in self.bpe.pretokens(c)] for k in hard.tolist()]
            words = [w for ws in cut for w in ws]
            sizes = np.array([len(ws) for ws in cut], np.int64)
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            number, clash = self.words.find(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends)[: len(words)])
            self._keep(number, sizes, self.used + hard)
            self.apart[self.used + hard[np.searchsorted(np.cumsum(sizes), clash, "right")]] = True
        self.used = n

    def find(self, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, list[int]]]:
        """For runs of texts without nulls: (texts, word numbers of all, where each text's begin and the last ends, texts to be handled otherwise)."""
        for run, offsets, data in pool.runs(texts, RUN_BYTES):
            starts, first = pool.split(offsets, data, _KIND[data] == _SPACE)
            at, clash = self.chunks.find(data, starts)
            wrong = np.concatenate([clash, np.flatnonzero(self.apart[at])])
            other = set((np.searchsorted(first, wrong, "right") - 1).tolist())
            raw = data.tobytes()
            for s in self.bpe.special:
                if s.encode() in raw:
                    other |= set(np.flatnonzero(pc.match_substring(run, s).to_numpy(zero_copy_only=False)).tolist())
            flat, ends = gather(self.numbers, self.first[at], self.size[at])
            yield run, flat, np.append(0, ends)[first], sorted(other)


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[first : first + size] of every run, one behind the other; where each ends)."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - size), size) + np.arange(total)], ends
