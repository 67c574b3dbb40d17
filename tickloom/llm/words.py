"""Encoding whole texts with a word-level cache in front of the tokenizers library.

The cache needs a vocabulary file that normalises and splits texts as told
below; with any other file every text goes to the library as it is.  A text of
such a vocabulary is cut at white space without changing
its ids, and a run of letters is encoded by the library's BPE model alone.
Texts or words outside a plain alphabet go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

PLAIN = re.compile(r"[ -&(-;=-~\n\t\rÀ-ÖØ-öø-ÿ]*").fullmatch       # no apostrophe (contractions), no "<" (special tokens)
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\s]+").findall
SPACE = re.compile(r"[ \n\t\r]+").split
# How the files that the cache is made for normalise and split texts.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
MOST_WORDS = 250_000        # words a worker remembers; then it starts anew


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word):
        ids = self[word] = self.encode(word)
        return ids


class WordEncoder:
    """``ids(text)`` equals the library's ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(self.tokenizer.to_str())
        self.cached = made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER
        letters = _byte_letters()
        self._stand_in = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        model = self.tokenizer.model
        stand_in = self._stand_in

        def piece(word: str) -> bytes:
            shown = word if word.isascii() else word.translate(stand_in)
            return np.array([t.id for t in model.tokenize(shown)], "<u4").tobytes()

        def chunk(word: str) -> bytes:
            if PLAIN(word):
                return b"".join(map(piece, PIECES(word.lower())))
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

        self._pieces, self._chunks = _Cache(piece), _Cache(chunk)

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cached:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for cache in (self._pieces, self._chunks):
            if len(cache) > MOST_WORDS:
                cache.clear()
        if PLAIN(text):
            return b"".join(map(self._pieces.__getitem__, PIECES(text.lower())))
        return b"".join(map(self._chunks.__getitem__, SPACE(text)))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary file."""
    return WordEncoder(path)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
