"""Recursive smoothing (exponential and Wilder means) as ordinary windows.

The recursion ``y = a * y' + (1 - a) * x``, seeded with the plain mean of the
first ``n`` valid inputs, is a weighted running sum.  Weights relative to the
first bar would overflow, so bars are cut into blocks: inside a block the sum
is one running window, and what earlier blocks add fades by ``a ** block``.
Enough block ends are carried on to make the rest smaller than a double can
show.  Slow smoothings take longer blocks, so that a few of them suffice; the
smoothings of a frame with blocks of the same size share their windows and sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.layout import Layout

NEGLIGIBLE = 36.0  # -ln of the share of older blocks that is left out
LARGEST = 600.0    # ln of the largest weight in a block; doubles end near 709
MOST_CARRIED = 6   # blocks carried on


@dataclass(frozen=True)
class Smoothing:
    """``source`` is non-NULL from bar ``first`` on; the result starts at bar ``first + period - 1``."""

    source: Column | None       # None: only its reach is asked for
    keep: float
    period: int
    first: int = 1

    @property
    def seed_bar(self) -> int:
        return self.first + self.period - 1

    @property
    def reach(self) -> int:
        """Bars back that still show in a double."""
        return self.seed_bar + (math.ceil(NEGLIGIBLE / -math.log(self.keep)) if self.keep else 0)


def exponential(source: Column | None, period: int, first: int = 1) -> Smoothing:
    return Smoothing(source, 1 - 2 / (period + 1), period, first)


def wilder(source: Column | None, period: int, first: int = 1) -> Smoothing:
    return Smoothing(source, 1 - 1 / period, period, first)


def block_size(s: Smoothing, base: int) -> int:
    """Bars of a block: short enough for the weights to stay finite, long enough for few to be carried."""
    size = base
    while size > 1 and -math.log(s.keep) * size > LARGEST:
        size //= 2
    while _carried_blocks(s, size) > MOST_CARRIED and -math.log(s.keep) * 2 * size <= LARGEST:
        size *= 2
    return size


def _carried_blocks(s: Smoothing, size: int) -> int:
    return math.ceil(NEGLIGIBLE / (size * -math.log(s.keep)))


def smooth(df: DataFrame, lay: Layout, wanted: dict[str, Smoothing], before: int = 0) -> DataFrame:
    """Adds one column per entry of ``wanted``; ``before`` is how far back their sources read."""
    for name, s in wanted.items():
        lay.reach(name, s.reach + before)
    df = df.withColumns({n: s.source for n, s in wanted.items() if s.keep == 0})    # period 1: the input itself
    by_size: dict[int, dict[str, Smoothing]] = {}
    for name, s in wanted.items():
        if s.keep > 0:
            by_size.setdefault(block_size(s, lay.block_rows), {})[name] = s
    for size, some in by_size.items():
        df = _smooth_in_blocks(df, lay, size, some)
    return df


def _smooth_in_blocks(df: DataFrame, lay: Layout, size: int, wanted: dict[str, Smoothing]) -> DataFrame:
    block = "block"
    if size != lay.block_rows:
        block = "_block"
        df = df.withColumn(block, F.floor(F.col("bar_no") / size))
    along = lay.window(order=(block, "ts"))
    running = lay.window(block, order=("ts",)).rowsBetween(Window.unboundedPreceding, 0)
    offset = F.col("bar_no") % size
    locals_ = {}
    for name, s in wanted.items():
        weight = F.pow(F.lit(1 / s.keep), offset)
        seeded, sown = F.col("bar_no") <= s.seed_bar, F.col("bar_no") >= s.first
        if s.seed_bar < size:       # the seed lies in the first block: its inputs all weigh the same
            term = F.when(sown, s.source * F.when(seeded, F.lit(s.keep**-s.seed_bar / s.period)).otherwise((1 - s.keep) * weight))
        else:
            inputs = F.sum(F.when(sown & seeded, s.source)).over(along.rowsBetween(Window.unboundedPreceding, 0))
            term = F.when(F.col("bar_no") == s.seed_bar, inputs / s.period * weight).when(~seeded, (1 - s.keep) * s.source * weight)
            df = df.withColumn(f"_{name}_term", term)
            term = F.col(f"_{name}_term")
        locals_[f"_{name}"] = F.sum(term).over(running) * F.pow(F.lit(s.keep), offset)
    df = df.withColumns(locals_).drop(*[f"_{n}_term" for n in wanted])

    depth = {n: _carried_blocks(s, size) for n, s in wanted.items()}
    block_end = offset == size - 1
    for level in range(1, max(depth.values(), default=0) + 1):
        # what all earlier blocks hand to this one, one block deeper per pass
        handed = {}
        for name, s in wanted.items():
            if depth[name] >= level:
                so_far = F.coalesce(f"_{name}", F.lit(0.0))
                if level > 1:
                    so_far = so_far + s.keep**size * F.coalesce(F.col(f"_{name}_in"), F.lit(0.0))
                handed[f"_{name}_in"] = F.last(F.when(block_end, so_far), ignorenulls=True).over(
                    along.rowsBetween(Window.unboundedPreceding, -1)
                )
        df = df.withColumns(handed)

    results = {
        name: F.when(
            F.col("bar_no") >= s.seed_bar,
            F.coalesce(f"_{name}", F.lit(0.0)) + F.coalesce(F.col(f"_{name}_in"), F.lit(0.0)) * F.pow(F.lit(s.keep), offset + 1),
        )
        for name, s in wanted.items()
    }
    return df.withColumns(results).drop(*locals_, *[f"{n}_in" for n in locals_], *(["_block"] if block == "_block" else []))
