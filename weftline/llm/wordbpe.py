"""Byte-level BPE with word ends: the parts that counting and encoding share.

The vocabulary file normalises (NFC, white space to blanks, lower case), drops white space, splits
words by a pattern and marks the last symbol of a pre-token with the end-of-word suffix. Pre-tokens
never cross white space, so a text is handled chunk by chunk, and each distinct chunk once.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import regex

# Unicode White_Space; str.split() splits at U+001C-U+001F as well, which are not white space there.
_SPACE = re.compile("[\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if it is a printable Latin-1 character, else 256 upwards in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Tables of a tokenizers .json file with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalizer = Tokenizer.from_file(path).normalizer
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix: str = model["end_of_word_suffix"]
        self.merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        chars = byte_chars()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in chars], np.int64)
        self._special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def merge_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pair keys, their ranks and the ids that they merge to."""
        n = len(self.strings)
        key = np.array([self.vocab[a] * n + self.vocab[b] for a, b in self.merges], np.int64)
        to = np.array([self.vocab[a + b] for a, b in self.merges], np.int64)
        order = np.argsort(key, kind="stable")
        return key[order], order.astype(np.int64), to[order]

    def pieces(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as pieces of their own."""
        if self._special_split is None or not any(s in text for s in self.special):
            return [text]
        return self._special_split.split(text)

    def text_chunks(self, text: str) -> list[str]:
        """Chunks between white space; special strings are chunks of their own."""
        pieces = self.pieces(text)
        if len(pieces) == 1:
            return self.chunks(text)
        return [c for p in pieces for c in ([p] if p in self.special else self.chunks(p))]

    @staticmethod
    def chunks(piece: str) -> list[str]:
        if _SEPARATORS.search(piece):
            return [c for c in _SPACE.split(piece) if c]
        return piece.split()

    def pretokens(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return [chunk.encode()]
        else:
            chunk = self.normalizer.normalize_str(chunk)
        return [w.encode() for w in self.words.findall(chunk)]

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the base symbols of all words, offsets)."""
        sizes = np.array([len(w) for w in words], np.int64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ends = off[1:][sizes > 0] - 1
        ids[ends] = self.final[raw[ends]]
        return ids, off


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)
