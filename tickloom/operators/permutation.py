"""Permutation test: how often returns in random order do at least as well as the rule.

A rule that is long on m bars collects m returns; under a random order it
collects the m whose hashes are smallest.  The hash of a bar under one order
mixes the key, the bar's number and the order's number, so any task can redo
it and no bar is ever copied per order: a task holds arrays with one place per
order and adds its bars to all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.compare import EPS
from tickloom.plans.layout import Layout
from tickloom.session import settle

REPETITIONS = 1_000
AT_ONCE = 1 << 16           # hashes a task holds at a time; they stay in the cache of a core
CELLS = 64                  # cells around the expected cut
SPREAD = 8.0                # standard deviations that they span to each side
# Multipliers of a published 32-bit finaliser.
MIX_A, MIX_B = 0x85EBCA6B, 0xC2B2AE35


def mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one on 32 bits; every bit of the input reaches every bit of the result."""
    x = x.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX_A)
    x ^= x >> np.uint32(13)
    x *= np.uint32(MIX_B)
    return x ^ x >> np.uint32(16)


def _orders(first: int, last: int) -> np.ndarray:
    return mixed(np.arange(first, last))[:, None]


def _blocks(bars: int, repetitions: int) -> Iterator[tuple[int, int]]:
    size = max(1, AT_ONCE // max(1, bars))
    for first in range(1, repetitions + 1, size):
        yield first, min(first + size, repetitions + 1)


def _numbered(df: DataFrame, groups: Sequence[str], keys: Sequence[str]) -> DataFrame:
    seed = F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long")
    return df.filter(F.col("bar_ret").isNotNull()).select(*groups, "bar_no", "bar_ret", "pos", seed.alias("_seed"))


def _own(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    number, seed = rows.column("bar_no").to_numpy(), rows.column("_seed").to_numpy()
    return mixed((number + seed) & 0xFFFFFFFF), rows.column("bar_ret").to_numpy()


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", " + more


def permutation_test(df: DataFrame, lay: Layout, repetitions: int = REPETITIONS) -> DataFrame:
    """``n_long, stat, p_value`` per key, from ``pos``, ``bar_ret`` and ``bar_no``.

    ``p_value`` counts the order that was observed as one more,
    (wins + 1) / (repetitions + 1), so it is never 0.  Bars of a key have
    different hashes up to 2 ** 32 of them; beyond, the bar's number decides.
    """
    keys = list(lay.keys)
    bars = _numbered(df, lay.groups, keys)
    if lay.chunked:
        return _by_chunks(bars, keys, repetitions)
    return bars.groupBy(*keys).applyInArrow(_whole(keys, repetitions), _schema(bars, keys, "n_long long, stat double, p_value double"))


def _smallest(hashes: np.ndarray, returns: np.ndarray, m: int) -> np.ndarray:
    """Per row the sum of the returns with the m smallest hashes.

    They lie at or below the m-th hash, which is found without carrying places
    along.  Equal hashes and returns that are not finite need the places.
    """
    taken = hashes <= np.partition(hashes, m - 1, axis=1)[:, m - 1:m]
    if np.count_nonzero(taken) == m * len(hashes) and np.isfinite(returns).all():
        return taken @ returns
    return returns[np.argpartition(hashes, m - 1, axis=1)[:, :m]].sum(axis=1)


def _whole(keys: Sequence[str], repetitions: int) -> Callable[[pa.Table], pa.Table]:
    def test(rows: pa.Table) -> pa.Table:
        own, returns = _own(rows)
        held = rows.column("pos").to_numpy() == 1
        m, stat, wins = int(held.sum()), float(returns[held].sum()), 0
        for first, last in _blocks(len(own), repetitions):
            if 0 < m < len(own):
                hashes = mixed(own[None, :] ^ _orders(first, last))
                sums = _smallest(hashes, returns, m)
            else:
                sums = np.full(last - first, returns.sum() if m else 0.0)
            wins += int((sums >= stat - EPS).sum())
        found = {"n_long": pa.array([m]), "stat": pa.array([stat]), "p_value": pa.array([(wins + 1) / (repetitions + 1)])}
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in keys}, **found})

    return test


def _cell_of(hashes: np.ndarray, m: int, n: int) -> np.ndarray:
    """1 to ``CELLS`` around the place where the m-th of n hashes is expected, 0 below, CELLS + 1 above."""
    share = m / n
    reach = SPREAD * max(np.sqrt(share * (1 - share) / n), 1 / n) * 2**32
    low, high = max(0, int(share * 2**32 - reach)), min(1 << 32, int(share * 2**32 + reach) + 1)
    width = -(-(high - low) // CELLS)
    return np.clip((hashes.astype(np.int64) - low) // width + 1, 0, CELLS + 1)


def _cells(keys: Sequence[str], repetitions: int) -> Callable[[pa.Table], pa.Table]:
    def add(rows: pa.Table) -> pa.Table:
        own, returns = _own(rows)
        m, n = rows.column("n_long")[0].as_py(), rows.column("_n")[0].as_py()
        counts, totals = [], []
        for first, last in _blocks(len(own), repetitions):
            cell = _cell_of(mixed(own[None, :] ^ _orders(first, last)), m, n)
            place = (cell + np.arange(last - first)[:, None] * (CELLS + 2)).ravel()
            size = (last - first) * (CELLS + 2)
            counts.append(np.bincount(place, minlength=size))
            totals.append(np.bincount(place, np.tile(returns, last - first), size))
        count, total = np.concatenate(counts), np.concatenate(totals)
        at = np.flatnonzero(count)
        named = {k: rows.column(k).take(pa.array(np.zeros(len(at), np.int64))) for k in keys}
        return pa.table({**named, "rep": pa.array((at // (CELLS + 2) + 1).astype(np.int32)), "cell": pa.array((at % (CELLS + 2)).astype(np.int32)),
                         "n": pa.array(count[at]), "total": pa.array(total[at])})

    return add


def _inside(keys: Sequence[str], repetitions: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pick(rows: pa.Table, cuts: pa.Table) -> pa.Table:
        own, returns = _own(rows) if rows.num_rows else (np.zeros(0, np.uint32), np.zeros(0))
        wanted = np.full(repetitions + 1, -1)
        wanted[cuts.column("rep").to_numpy()] = cuts.column("cell").to_numpy()
        number = rows.column("bar_no").to_numpy()
        parts = []
        for first, last in _blocks(len(own), repetitions) if len(own) else ():
            hashes = mixed(own[None, :] ^ _orders(first, last))
            cell = _cell_of(hashes, rows.column("n_long")[0].as_py(), rows.column("_n")[0].as_py())
            order, bar = np.nonzero(cell == wanted[first:last, None])
            parts.append((order + first, hashes[order, bar].astype(np.int64), number[bar], returns[bar]))
        order, hash_, bar_no, ret = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0)] * 4
        named = {k: rows.column(k).take(pa.array(np.zeros(len(order), np.int64))) for k in keys}
        return pa.table({**named, "rep": pa.array(order.astype(np.int32)), "hash": pa.array(hash_.astype(np.int64)),
                         "bar_no": pa.array(bar_no.astype(np.int64)), "bar_ret": pa.array(ret.astype(float))})

    return pick


def _by_chunks(bars: DataFrame, keys: Sequence[str], repetitions: int) -> DataFrame:
    """The same for keys of any size, in two passes over the chunks.

    The m-th smallest hash lies near m / n of the way, so a chunk adds its bars
    to a few cells around that place, one below and one above; sums over the
    chunks tell the cell that holds the cut.  The second pass ranks the bars of
    that one cell, wherever it lies.
    """
    bars = settle(bars)
    held = F.when(F.col("pos") == 1, F.col("bar_ret"))
    stats = settle(bars.groupBy(*keys).agg(
        F.count(held).alias("n_long"), F.coalesce(F.sum(held), F.lit(0.0)).alias("stat"), F.count(F.lit(1)).alias("_n")
    ))
    told = bars.join(stats.select(*keys, "n_long", "_n"), keys)
    cells = told.groupBy(*keys, "chunk").applyInArrow(_cells(keys, repetitions), _schema(bars, keys, "rep int, cell int, n long, total double"))
    cells = cells.groupBy(*keys, "rep", "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    before = Window.partitionBy(*keys, "rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = settle(cells.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(stats.select(*keys, "n_long"), keys))
    full = F.sum(F.when(F.col("_before") + F.col("n") <= F.col("n_long"), F.col("total")))
    below = cells.groupBy(*keys, "rep").agg(full.alias("_full"))
    cut = cells.filter((F.col("_before") < F.col("n_long")) & (F.col("_before") + F.col("n") > F.col("n_long")))
    cuts = settle(bars.select(*keys, "chunk").distinct().join(cut.select(*keys, "rep", "cell"), keys))
    group = [*keys, "chunk"]
    inside = told.groupBy(*group).cogroup(cuts.groupBy(*group)).applyInArrow(
        _inside(keys, repetitions), _schema(bars, keys, "rep int, hash long, bar_no long, bar_ret double")
    )
    ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("hash", "bar_no")))
    need = cut.select(*keys, "rep", (F.col("n_long") - F.col("_before")).alias("_need"))
    part = ranked.join(need, [*keys, "rep"]).filter(F.col("_rank") <= F.col("_need")).groupBy(*keys, "rep").agg(F.sum("bar_ret").alias("_part"))
    by_chance = F.coalesce("_full", F.lit(0.0)) + F.coalesce("_part", F.lit(0.0))
    won = below.join(part, [*keys, "rep"], "left").join(stats, keys).groupBy(*keys, "n_long", "stat").agg(
        F.count_if(by_chance >= F.col("stat") - EPS).alias("_wins")
    )
    return won.select(*keys, "n_long", "stat", ((F.col("_wins") + 1) / (repetitions + 1)).alias("p_value"))
