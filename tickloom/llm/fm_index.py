"""A bidirectional FM-index over the word ids of one shard.

The text is an array of ids with 0 as a break, which no phrase may hold.  One
half lists, for every place of the text in the order of what follows it, the
word before it; the other half is the same of the text read backwards.  A
phrase is an interval of each half: looking up which words stand before an
interval extends the phrase to the left, in the backward half to the right.
Phrases up to ``depth`` words are enumerated, so the order need not look
further than that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the text by their next ``depth`` words: ranks of longer and longer starts."""
    rank, known = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        inside = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, inside[1:] != inside[:-1]]) if len(inside) else inside
        known += step
    return order


class _Half:
    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.before = text[_order(text, depth) - 1]     # the transform: the word before each place
        self.seats = np.argsort(self.before, kind="stable")     # where each word stands in it, word by word
        self.seats += self.before[self.seats].astype(np.int64) * len(text)

    def start(self, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """First place of the interval that ``word`` opens before the interval starting at ``low``."""
        return np.searchsorted(self.seats, word.astype(np.int64) * len(self.before) + low)


@dataclass
class Phrases:
    """Phrases of one length: their words, and their intervals in both halves."""

    words: np.ndarray       # one row per phrase
    low: tuple[np.ndarray, np.ndarray]
    count: np.ndarray


class WordIndex:
    def __init__(self, text: np.ndarray, depth: int) -> None:
        text = np.r_[0, text, 0].astype(np.int32)
        self.halves = _Half(text, depth), _Half(text[::-1], depth)
        self.counts = np.bincount(text)

    def single(self) -> Phrases:
        words = np.flatnonzero(self.counts[1:]) + 1
        low = (np.cumsum(self.counts) - self.counts)[words]
        return Phrases(words[:, None], (low, low), self.counts[words])

    def extended(self, phrases: Phrases, right: bool) -> Phrases:
        """Every phrase with every word that stands before (or after) it, with its count."""
        side, other = (1, 0) if right else (0, 1)
        begin = np.cumsum(phrases.count) - phrases.count
        base = len(self.counts)
        rows = np.repeat(phrases.low[side] - begin, phrases.count)
        rows += np.arange(len(rows))
        owned = np.repeat(np.arange(len(phrases.count)) * base, phrases.count)
        owned += self.halves[side].before[rows]
        del rows
        pairs, count = np.unique(owned, return_counts=True)
        owner, word = pairs // base, pairs % base
        # in the other half the interval is cut by the new word, in the order of the words
        passed = np.cumsum(count) - count - begin[owner]
        moved = phrases.low[other][owner] + passed
        real = word > 0
        owner, word, count, moved = owner[real], word[real], count[real], moved[real]
        near = self.halves[side].start(word, phrases.low[side][owner])
        old, new = phrases.words[owner], word[:, None]
        words = np.hstack([old, new] if right else [new, old])
        return Phrases(words, (moved, near) if right else (near, moved), count)

    def enumerate(self, longest: int):
        """Phrases of 2 words, 3 words and so on, extended to the left and to the right in turn."""
        phrases = self.single()
        for length in range(2, longest + 1):
            phrases = self.extended(phrases, right=length % 2 == 1)
            yield phrases
