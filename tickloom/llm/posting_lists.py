"""Sorted lists of ids, merged by galloping: doubling steps to the next id sought, then halving inside the last step."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence


def gallop(ids: Sequence[int], sought: int, at: int) -> int:
    """First place from ``at`` on whose id is not below ``sought``."""
    step, ahead, size = 1, at, len(ids)
    while ahead < size and ids[ahead] < sought:
        at = ahead + 1
        ahead += step
        step *= 2
    return bisect_left(ids, sought, at, min(ahead, size))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Ids of any list: the list with the smallest head gives all it has before the next head."""
    live = [(ids, 0) for ids in lists if ids]
    out: list[int] = []
    while len(live) > 1:
        live.sort(key=lambda list_: list_[0][list_[1]])
        (ids, at), (other, place) = live[0], live[1]
        end = gallop(ids, other[place], at)
        out.extend(ids[at:end])
        if end < len(ids) and ids[end] == other[place]:
            end += 1        # the other list still holds it
        live[0] = ids, end
        if end == len(ids):
            del live[0]
    for ids, at in live:
        out.extend(ids[at:])
    return out


def difference(ids: Sequence[int], other: Sequence[int]) -> list[int]:
    """Ids that ``other`` does not hold, taken run by run."""
    out: list[int] = []
    at = place = 0
    while at < len(ids):
        place = gallop(other, ids[at], place)
        if place == len(other):
            out.extend(ids[at:])
            break
        end = gallop(ids, other[place], at)
        out.extend(ids[at:end])
        at = end + 1 if end < len(ids) and ids[end] == other[place] else end
    return out


def common(ids: Sequence[int], other: Sequence[int]) -> int:
    """How many ids both lists hold."""
    if len(ids) > len(other):
        ids, other = other, ids
    found = place = 0
    for sought in ids:
        place = gallop(other, sought, place)
        if place == len(other):
            break
        found += other[place] == sought
    return found
