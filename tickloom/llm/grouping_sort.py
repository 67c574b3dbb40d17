"""Suffix sorting by linear grouping construction.

First all suffixes are put into groups by their Lyndon prefix (the longest
prefix that is a Lyndon word), without comparing strings: groups start out by
first symbol and are taken from the largest down.  For each suffix of a group
the previous smaller one is found by following pointers; its prefix grows by
the group's prefix, so it moves to a new group right behind its old one, the
further the more often that happens.  Then the order inside the groups is
emitted in one pass over the result itself: a suffix is its Lyndon prefix
followed by the next smaller suffix, which is already in place.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(symbols: Sequence[int]) -> list[int]:
    """For each suffix the place in the suffix array at which its group begins."""
    n = len(symbols)
    members: dict[int, list[int]] = {}
    for i, x in enumerate(symbols):
        members.setdefault(x, []).append(i)
    group, previous = [0] * n, [-1] * n
    count: dict[int, int] = {}
    begin_of: dict[int, int] = {}       # first place of the group that ends at a place
    listed: dict[int, list[int]] = {}
    at = 0
    for x in sorted(members):
        own = members[x]
        for i in own:
            group[i] = at
        count[at], listed[at] = len(own), own
        begin_of[at + len(own) - 1] = at
        at += len(own)

    top = n
    while top > 0:
        g = begin_of[top - 1]
        times: dict[int, int] = {}
        for i in sorted([i for i in listed.pop(g) if group[i] == g]):
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            growing: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                growing.setdefault((k, group[p]), []).append(p)
            for _, h in sorted(growing, reverse=True):
                moved = growing[_, h]
                size = count[h]
                stay = size - len(moved)
                if stay:        # else they are all that is left of their group, which keeps its place
                    new = h + stay
                    count[h], count[new] = stay, len(moved)
                    begin_of[h + size - 1], begin_of[new - 1] = new, h
                    listed[new] = moved
                    for p in moved:
                        group[p] = new
        top = g
    return group


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes in ascending order; the last symbol must be the smallest and occur once."""
    n = len(symbols)
    if not n:
        return []
    group = lyndon_groups(symbols)
    smaller = [n] * n       # next smaller suffix
    first, sibling = [-1] * (n + 1), [-1] * n       # suffixes whose next smaller one is a given one
    for i in range(n - 1, -1, -1):
        j = i + 1
        g = group[i]
        while j < n and group[j] > g:
            j = smaller[j]
        smaller[i] = j
        sibling[i], first[j] = first[j], i
    free = list(range(n))
    order = [0] * n
    order[0] = n - 1
    for place in range(n):
        i = first[order[place]]
        while i >= 0:
            g = group[i]
            order[free[g]] = i
            free[g] += 1
            i = sibling[i]
    return order
