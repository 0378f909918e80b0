"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique: it is the one token, among
those that match a suffix of the prefix, that is compatible with the last token of what stands
before it. An automaton yields the suffix matches, a test on the two tokens' merge histories decides
compatibility, and back-pointers from the whole word give the ids that merging would give.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textwords, wordbpe

CACHE_CHUNKS = 400_000
CACHE_PAIRS = 200_000
CACHE_EDGES = 10_000


class PrefixEncoder:
    def __init__(self, path: str):
        self.bpe = bpe = wordbpe.load(path)
        vocab = bpe.vocab
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(bpe.merges)}
        #: The two tokens that a token is merged from (none: -1), and at which rank.
        size = max(vocab.values()) + 1
        self.parts = np.full((2, size), -1, np.int32)
        self.formed = np.zeros(size, np.int32)
        for r, (a, b) in enumerate(bpe.merges):
            t = vocab[a + b]
            self.parts[:, t], self.formed[t] = (vocab[a], vocab[b]), r
        self.edges: tuple[dict, dict] = ({}, {})
        # A token is a word over base symbols, one character each; the last symbol of a word is another character.
        inner, final = bpe.inner.tolist(), bpe.final.tolist()
        symbol = {i: chr(0xE000 + b) for b, i in enumerate(inner)} | {i: chr(0xE100 + b) for b, i in enumerate(final)}
        spell: dict[int, str] = dict(symbol)
        for a, b in bpe.merges:
            spell[vocab[a + b]] = spell[vocab[a]] + spell[vocab[b]]
        self.symbols = [chr(0xE000 + b) for b in range(256)]
        ends = {chr(0xE100 + b) for b in range(256)}
        self.automaton = ahocorasick.Automaton()
        for t, s in spell.items():
            if not (set(s[:-1]) & ends):
                self.automaton.add_word(s, (t, len(s)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self._drop_unreachable(spell, ends)

    def _drop_unreachable(self, spell: dict[int, str], ends: set[str]) -> None:
        """Tokens that merging never leaves whole, if the file has any, are no candidates."""
        self.unreachable: set[int] = set()
        for t, s in sorted(spell.items(), key=lambda x: len(x[1])):
            if len(s) > 1 and not (set(s[:-1]) & ends):
                a, b = self.parts[:, t].tolist()
                if a in self.unreachable or b in self.unreachable or not self._joins(a, b):
                    self.unreachable.add(t)

    def edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """Left (0) or right (1) edge of a token's merge tree, from the token down: (piece, rank at which the piece is used up)."""
        if (found := self.edges[side].get(t)) is None:
            piece, until, found = t, float("inf"), []
            while piece >= 0:
                found.append((piece, until))
                until, piece = int(self.formed[piece]), int(self.parts[side, piece])
            if len(self.edges[side]) >= CACHE_EDGES:
                self.edges[side].clear()
            self.edges[side][t] = found
        return found

    def _joins(self, a: int, b: int) -> bool:
        """Whether the first merge across a|b is that of a and b themselves."""
        top = self.rank[(a, b)]
        return not any((m := self.rank.get((p, q))) is not None and (p, q) != (a, b) and m < min(pu, top) and m <= min(qu, top) for p, pu in self.edge(a, 1) for q, qu in self.edge(b, 0))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a then b gives a and b: no merge across the boundary comes before its pieces are used up.

        At equal ranks the pair further left merges first.
        """
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            get, known = self.rank.get, True
            starts = self.edge(b, 0)
            for p, pu in self.edge(a, 1):
                for q, qu in starts:
                    if (m := get((p, q))) is not None and m < pu and m <= qu:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        if not word:
            return []
        sym = self.symbols
        text = "".join([sym[b] for b in word[:-1]]) + chr(0xE100 + word[-1])
        n = len(text)
        last, size = [-1] * n, [0] * n
        for end, (t, k) in self.automaton.iter(text):
            if last[end] < 0 and t not in self.unreachable:
                start = end - k
                if start < 0 or (last[start] >= 0 and self.compatible(last[start], t)):
                    last[end], size[end] = t, k
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class _Encoded:
    """Ids and decoded text of texts by way of those of their distinct words."""

    def __init__(self, path: str):
        self.encoder = PrefixEncoder(path)
        self.bpe = self.encoder.bpe
        self.words = textwords.TextWords(self.bpe, self._learn, self._forget, CACHE_CHUNKS)

    def _forget(self) -> None:
        self.first, self.size = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = self.n_ids = 0

    def _learn(self, words: list[bytes]) -> None:
        coded = list(map(self.encoder.encode_word, words))
        flat, size = np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded], np.int32)
        n, total = self.used + len(words), self.n_ids + len(flat)
        if n > len(self.size):
            self.first, self.size = (np.concatenate([x, np.zeros(n, np.int32)]) for x in (self.first, self.size))
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(total, np.uint32)])
        self.first[self.used : n], self.size[self.used : n] = self.n_ids + np.cumsum(size) - size, size
        self.ids[self.n_ids : total] = flat
        self.used, self.n_ids = n, total

    def one(self, text: str) -> np.ndarray:
        special = self.bpe.special
        ids = [i for c in self.bpe.text_chunks(text) for i in ([special[c]] if c in special else [i for w in self.bpe.pretokens(c) for i in self.encoder.encode_word(w)])]
        return np.array(ids, np.uint32)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for run, numbers, bounds, other in self.words.find(texts):
            ids, ends = textwords.gather(self.ids, self.first[numbers], self.size[numbers])
            parts = np.split(ids, np.append(0, ends)[bounds[1:-1]])
            for k in other:
                parts[k] = self.one(run[k].as_py())
            yield from parts


class Decoder:
    """Texts of ids: the strings of the tokens, special ones included, joined by blanks."""

    def __init__(self, path: str):
        strings = wordbpe.load(path).strings
        spelled = [strings.get(i, "").encode() + b" " for i in range(max(strings) + 1)]
        self.size = np.array([len(s) for s in spelled], np.int32)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8. Long lists go run by run, so that memory is bounded by the text."""
        runs = [ids[lo : lo + (1 << 18)] for lo in range(0, len(ids), 1 << 18)]
        return b"".join([textwords.gather(self.bytes, self.first[r], self.size[r])[0].tobytes() for r in runs])[:-1]


@lru_cache(maxsize=2)
def _encoded(path: str) -> _Encoded:
    return _Encoded(path)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[bytes, str]]:
    """(ids as little-endian 32-bit integers, decoded text) of each text."""
    for ids in _encoded(path).encode(pa.array(texts, pa.string())):
        yield ids.astype("<u4").tobytes(), _decoder(path).decode(ids).decode()


def decode_ids(ids: bytes, path: str) -> str:
    """The text that ids (little-endian 32-bit integers) stand for, special tokens included."""
    return _decoder(path).decode(np.frombuffer(ids, "<u4")).decode()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, decoded string; the text is decoded from the ids.

    Null and empty texts have no ids and decode to an empty text; very long texts are encoded whole. Special
    strings inside texts become their ids. Ties don't arise: each row is encoded by itself, repeated rows and
    null ids too. Other columns don't matter, whatever their names. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, decoder = _encoded(path), _decoder(path)
        for batch in batches:
            ids = list(encoded.encode(batch.column(1)))
            decoded = pa.array([decoder.decode(i).decode() for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() reduced where it is made: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, decoder = _encoded(path), _decoder(path)
        for batch in batches:
            rows = [(len(i), hashlib.sha256(i.astype("<u4")).hexdigest(), hashlib.sha256(decoder.decode(i)).hexdigest()) for i in encoded.encode(batch.column(1))]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
