"""A pool of the distinct pieces of texts: numpy arrays that map byte strings to numbers, many at once.

Pieces are hashed by differences of one running polynomial over the bytes of a batch, looked up in an open
hash table and compared byte by byte with the stored piece, so a number always means the very same bytes.
Only pieces met first become Python objects.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
MOST_BYTES = 1 << 28
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of the hash's base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1 << 18), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


class Pool:
    """Numbers of distinct pieces, from 0 upwards.

    ``learn`` gets the pieces met first, in the order of their numbers. Bounded: the pool starts again when it
    holds more than ``most`` pieces or MOST_BYTES, after calling ``forget``, which costs time only.
    """

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], most: int):
        self.learn, self.forget, self.most = learn, forget, most
        self.clear()

    def clear(self) -> None:
        self.used, self.n_bytes = 0, 0
        self.keys, self.numbers = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.first, self.size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.bytes = np.zeros(1 << 18, np.uint8)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _look(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for unknown ones."""
        at, mask = self._slots(h), len(self.keys) - 1
        key = self.keys[at]
        out = np.where(key == h, self.numbers[at], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        at = at[left]
        while len(left):
            at = at + 1 & mask
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.numbers[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], at[go]
        return out

    def _enter(self, h: np.ndarray, number: np.ndarray) -> None:
        """Distinct new hashes into the table."""
        at, mask = self._slots(h), len(self.keys) - 1
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]  # of several for one place the last stays
            own = self.keys[at] == h
            self.numbers[at[own]] = number[own]
            h, number, at = h[~own], number[~own], at[~own] + 1 & mask

    def _add(self, h: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        n, size = self.used + len(pieces), np.array([len(p) for p in pieces], np.int32)
        total = self.n_bytes + int(size.sum())
        if n > len(self.size):
            for k in ("first", "size"):
                old = getattr(self, k)
                setattr(self, k, np.concatenate([old, np.zeros(n, old.dtype)]))
        if total > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(total, np.uint8)])
        new = slice(self.used, n)
        self.first[new] = self.n_bytes + np.cumsum(size) - size
        self.size[new] = size
        self.bytes[self.n_bytes : total] = np.frombuffer(b"".join(pieces), np.uint8)
        number = np.arange(self.used, n, dtype=np.int32)
        self.used, self.n_bytes = n, total
        if 3 * n > 2 * len(self.keys):
            held = self.keys != 0
            keys, numbers = self.keys[held], self.numbers[held]
            bits = (2 * n).bit_length()
            self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._enter(keys, numbers)
        self._enter(h, number)
        self.learn(pieces)
        return number

    def find(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, positions of pieces that clash with another one's hash) of the pieces that begin at ``starts`` and fill ``data``."""
        if self.used > self.most or self.n_bytes > MOST_BYTES:
            self.clear()
            self.forget()
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        n = len(data)
        power = _power(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * power[:n], out=run[1:])
        size = np.diff(starts, append=n)
        h = np.diff(run[starts], append=run[n]) * power[n - starts]
        # aligned to the batch's end; undo that, so that the same piece hashes alike in every batch
        h = (h * _inverse_power(n) ^ size.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(31)
        h *= _BASE
        h[h == 0] = 1
        at = self._look(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            own, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            raw, begin = data.tobytes(), starts[miss[where]]
            pieces = [raw[b : b + s] for b, s in zip(begin.tolist(), size[miss[where]].tolist())]
            at[miss] = self._add(own, pieces)[back]
        wrong = self.size[at] != size
        if wrong.any():
            clash = np.flatnonzero(wrong)
        else:
            same = self.bytes[np.repeat(self.first[at] - starts, size) + np.arange(n)] == data
            clash = np.zeros(0, np.int64) if same.all() else np.unique(np.searchsorted(starts, np.flatnonzero(~same), "right") - 1)
        return at, clash


def _inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(pow(int(_BASE), n, 1 << 64), -1, 1 << 64))


def split(offsets: np.ndarray, data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, first): pieces begin where ``blank`` is true and where a text begins; first[k]: number of text k's first piece."""
    mark = np.zeros(len(data) + 1, bool)
    mark[:-1] = blank
    mark[offsets] = True
    starts = np.flatnonzero(mark[:-1])
    return starts, np.searchsorted(starts, offsets)


def runs(texts, most: int):
    """(texts, offsets, data) of runs of an Arrow string array without nulls, about ``most`` bytes each, one text at least."""
    import pyarrow as pa

    if not len(texts):
        return
    wide = texts.type in (pa.large_string(), pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield texts.slice(lo, hi - lo), offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi
