"""Byte-level BPE by the library, with every distinct chunk of text encoded once.

A chunk is a blank and what stands behind it up to the next blank. Chunks become numbers in a pool of bytes,
numbers become runs of 16-bit ids; only chunks met first are strings to Python.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import pool
from .wordbpe import byte_chars

CACHE_CHUNKS = 1_800_000  # distinct chunks that a worker remembers before it starts again
RUN_BYTES = 1 << 20  # of texts that are encoded together
END_ID = 0

#: The pre-token pattern of byte-level BPE vocabularies of this family (fixed value). Python's white space has four
#: characters more than the vocabulary's.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD = re.compile("[\0\x1c-\x1f]")
_JOINED = 64  # pre-tokens that the library gets at a time

# Kinds of bytes. Two-byte letters of Latin scripts (lead bytes C3 to C9) count as letters byte by byte.
_MARK, _LETTER, _DIGIT, _BLANK, _SPACE, _HARD = range(6)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[32:127] = _MARK
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_KIND[48:58], _KIND[32], _KIND[9:14], _KIND[ord("'")] = _DIGIT, _BLANK, _SPACE, _HARD


class ByteEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.stand_in = dict(enumerate(byte_chars()))
        nul, vocab = self.stand_in[0], self.lib.get_vocab(with_added_tokens=False)
        self.nul, self.nul_id = nul, vocab[nul]
        self.joins = not any(nul in t and t != nul for t in vocab)
        self.pool = pool.Pool(self._learn, self._forget, CACHE_CHUNKS)
        self.words = pool.Pool(self._learn_words, lambda: None, 1 << 60)  # starts again with the chunks
        self._forget()

    def _forget(self) -> None:
        self.words.clear()
        self.first, self.size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.opens, self.closes = np.zeros(1 << 15, bool), np.zeros(1 << 15, bool)
        self.word_first, self.word_size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.ids = np.zeros(1 << 18, np.uint16)
        self.used = self.n_words = self.n_ids = 0

    def _room(self, names: tuple[str, ...], n: int) -> None:
        for k in names:
            old = getattr(self, k)
            if n > len(old):
                setattr(self, k, np.concatenate([old, np.zeros(n, old.dtype)]))

    def _keep(self, ids: np.ndarray) -> int:
        """Put ids into the pool; where they begin."""
        begin = self.n_ids
        self._room(("ids",), begin + len(ids))
        self.ids[begin : begin + len(ids)] = ids
        self.n_ids += len(ids)
        return begin

    def _learn_words(self, words: list[bytes]) -> None:
        """Ids of pre-tokens by the library, a run at a time: no token but its own holds the NUL between them, so nothing merges over it."""
        ids = array("H")
        step = _JOINED if self.joins else 1
        for lo in range(0, len(words), step):
            letters = b"\0".join(words[lo : lo + step]).decode("latin-1").translate(self.stand_in)
            ids.extend([t.id for t in self.model.tokenize(letters)])
            ids.append(self.nul_id)
        flat = np.frombuffer(ids, np.uint16)
        ends = np.flatnonzero(flat == self.nul_id)
        begins = np.append(0, ends[:-1] + 1)
        n = self.n_words + len(words)
        self._room(("word_first", "word_size"), n)
        new = slice(self.n_words, n)
        self.word_first[new], self.word_size[new] = self._keep(flat) + begins, ends - begins
        self.n_words = n

    def _hard(self, chunk: str) -> list[int]:
        if _ODD.search(chunk):
            return self.lib.encode(chunk, add_special_tokens=False).ids
        return [t.id for w in _PRETOKEN.findall(chunk) for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.stand_in))]

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of chunks that were met first; ``opens`` and ``closes``: white space behind the blank, at the end.

        Chunks of easy bytes without white space side by side are cut where the kind of byte changes.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        long = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(long) - long
        kind = _KIND[data]
        before = np.append(_HARD, kind[:-1])
        before[starts] = _HARD
        space = (kind == _BLANK) | (kind == _SPACE)
        bad = (kind == _HARD) | (space & ((before == _BLANK) | (before == _SPACE)))
        cross = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the two marks among the Latin letters
        bad[:-1] |= cross
        hard = np.unique(np.searchsorted(starts, np.flatnonzero(bad), "right") - 1)
        # white space that goes on would be cut here, but such chunks are hard
        word = np.flatnonzero((kind != before) & (before != _BLANK))
        easy = np.ones(len(pieces), bool)
        easy[hard] = False
        if len(hard):
            own = np.repeat(np.arange(len(pieces)), long)
            data = data[easy[own]]
            word = word[easy[own[word]]]
            gone = np.cumsum(np.where(easy, 0, long))
            word = word - gone[own[word]]
        begin = np.cumsum(np.where(easy, long, 0)) - np.where(easy, long, 0)
        number, clash = self.words.find(data, word)
        first_word = np.searchsorted(word, begin[easy])
        if len(clash):
            hard = np.concatenate([hard, np.flatnonzero(easy)[np.unique(np.searchsorted(first_word, clash, "right") - 1)]])
        n = self.used + len(pieces)
        self._room(("first", "size", "opens", "closes"), n)
        first, size = self.first[self.used : n], self.size[self.used : n]
        count = np.diff(first_word, append=len(word))
        if len(number):
            each = self.word_size[number]
            size[easy] = np.add.reduceat(each, first_word)
            first[easy] = self.word_first[number[first_word]]
            several = np.flatnonzero(easy)[count > 1]
            if len(several):
                at = number[np.repeat(count > 1, count)]
                each = self.word_size[at]
                ends = np.cumsum(each, dtype=np.int64)
                begins = self._keep(self.ids[np.repeat(self.word_first[at] - (ends - each), each) + np.arange(ends[-1])])
                first[several] = begins + np.cumsum(size[several], dtype=np.int64) - size[several]
        self.opens[self.used : n] = (long < 2) | (kind[np.minimum(starts + 1, len(kind) - 1)] == _SPACE)
        self.closes[self.used : n] = space[starts + long - 1]
        for k in hard.tolist():
            chunk = pieces[k].decode()
            ids = self._hard(chunk)
            first[k], size[k] = self._keep(np.array(ids, np.uint16)), len(ids)
            self.opens[self.used + k] = len(chunk) < 2 or chunk[1].isspace()
            self.closes[self.used + k] = chunk[-1].isspace()
        self.used = n

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts without nulls, in order: (number of ids of each, END_ID among them; all their 16-bit ids)."""
        for run, offsets, data in pool.runs(texts, RUN_BYTES):
            yield self._run(run, offsets, data)

    def _run(self, texts: pa.Array, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first = pool.split(offsets, data, data == 32)
        at, clash = self.pool.find(data, starts)
        # white space that goes on over a blank is cut elsewhere than at the blank
        on = np.flatnonzero(self.closes[at[:-1]] & self.opens[at[1:]]) + 1
        wrong = np.concatenate([clash, on[~np.isin(on, first)]])
        wrong = set((np.searchsorted(first, wrong, "right") - 1).tolist())
        for s in self.special:
            if s.encode() in memoryview(data).tobytes():
                wrong |= set(np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist())
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        before = np.append(0, ends)[first]  # ids of the pieces before each text, and of all
        n = len(texts)
        # a text's ids and the end id behind them
        shift = np.repeat(np.arange(n), np.diff(first))
        ids = np.full(before[-1] + n, END_ID, np.uint16)
        if len(at):
            flat = self.ids[np.repeat(self.first[at] - (ends - size), size) + np.arange(ends[-1])]
            ids[np.repeat(shift, size) + np.arange(ends[-1])] = flat
        total = np.diff(before) + 1
        if wrong:
            parts = np.split(ids, np.cumsum(total)[:-1])
            for k in wrong:
                parts[k] = np.array([*self.lib.encode(texts[k].as_py(), add_special_tokens=False).ids, END_ID], np.uint16)
                total[k] = len(parts[k])
            ids = np.concatenate(parts)
        return total, ids


@lru_cache(maxsize=2)
def load(path: str) -> ByteEncoder:
    return ByteEncoder(path)
