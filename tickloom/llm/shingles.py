"""Sets of five-word shingles as sorted 64-bit hashes, for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tickloom.llm.blobs import spread

WORDS = 5
BYTES = 1 << 20     # text taken in one go; a longer text goes alone

_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, "u8") | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, "u8")


def _powers(size: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < size:
        base = np.full(max(size, 2 * len(_POWERS)), _STEP, "u8")
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the text it is in."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts), "u1")]
    if not len(raw):
        return np.zeros(0, "u8"), np.zeros(0, int)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(starts):
        return np.zeros(0, "u8"), np.zeros(0, int)
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)       # place of a letter in its word
    letters = _LETTERS[raw[~space]] * _powers(int(sizes.max()) + 1)[at]
    hashes = spread(np.add.reduceat(letters, begin) + sizes.astype("u8"))
    text_starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    return hashes, np.searchsorted(text_starts, starts, "right") - 1


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The set of each text: distinct five-word shingles, the whole sequence where there are fewer words, or nothing."""
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    joined = np.zeros(max(0, len(words) - WORDS + 1), "u8")
    for k in range(WORDS):
        joined = (joined ^ words[k:k + len(joined)]) * np.uint64(2 * k + 0x9E3779B97F4A7C15)
        joined ^= joined >> np.uint64(29)
    joined = spread(joined)
    out = []
    for i in range(len(texts)):
        s, e = bounds[i], bounds[i + 1]
        if e - s >= WORDS:
            out.append(np.unique(joined[s:e - WORDS + 1]))
        elif e > s:
            one = np.array([e - s], "u8")
            for w in words[s:e]:
                one = spread(one ^ w) * np.uint64(0xD6E8FEB86659FD93)
            out.append(one)
        else:
            out.append(np.zeros(0, "u8"))
    return out


def in_portions(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, about ``BYTES`` at a time, with the index of the first; null is empty."""
    held: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if held and size + len(raw) > BYTES:
            yield first, held
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit key of the set, as a signed number."""
    mixed = spread(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(spread(mixed.sum(dtype="u8", keepdims=True) + np.uint64(len(tokens))).astype("i8")[0])
