"""Stationary bootstrap of returns: blocks of random length, put together until the series is as long as it was.

A block is a difference of two prefix sums, so nothing is resampled: an order
of blocks is a list of places, drawn from a hash of key, repetition and block,
that any task can redo.  Keys too large for one task send the places to the
chunks that hold them and add up what comes back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.permutation import AT_ONCE, REPETITIONS, mixed
from tickloom.plans.layout import Layout, carry_in, own_rows
from tickloom.session import settle

BLOCK = 20                  # mean length of a block
SEGMENT = 65_536            # places of the new series drawn on their own; a block ends with its segment
TOGETHER = 50               # repetitions whose places travel together
_GOLDEN = 0x9E3779B9



def _packed(code: np.ndarray, adds: np.ndarray) -> bytes:
    """Places (numbered through repetitions and rows) as distances, with a bit for the sign: little over a byte each."""
    order = np.argsort(code, kind="stable")
    apart = np.diff(code[order], prepend=0)
    width = 1 if apart.max(initial=0) < 256 else 8
    return len(code).to_bytes(4, "little") + bytes([width]) + apart.astype(f"<u{width}").tobytes() + np.packbits(adds[order]).tobytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and signs (+1 or -1) of what :func:`_packed` wrote."""
    count, width = int.from_bytes(packed[:4], "little"), packed[4]
    apart = np.frombuffer(packed, f"<u{width}", count, 5)
    adds = np.unpackbits(np.frombuffer(packed, np.uint8, offset=5 + width * count), count=count)
    return np.cumsum(apart, dtype=np.int64), 2.0 * adds - 1


def _draws(seed: int, segment: int, size: int, bars: int, first: int, last: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repetition, start, length) of the blocks that fill ``size`` places from ``bars`` bars."""
    rep = mixed(np.arange(first, last))[:, None]
    base = seed + segment * _GOLDEN
    count = int(1.5 * size / block) + 20
    while True:
        number = np.arange(count)
        starts = mixed(mixed((base + 2 * number) & 0xFFFFFFFF)[None, :] ^ rep).astype(np.uint64) * np.uint64(bars) >> np.uint64(32)
        chance = (mixed(mixed((base + 2 * number + 1) & 0xFFFFFFFF)[None, :] ^ rep) + 1.0) / 2.0**32
        length = 1 + (np.log(chance) / math.log(1 - 1 / block)).astype(np.int64) if block > 1 else np.ones(chance.shape, np.int64)
        end = np.cumsum(length, axis=1)
        if (end[:, -1] >= size).all():
            break
        count *= 2
    before = end - length
    order, at = np.nonzero(before < size)
    return order + first, starts[order, at].astype(np.int64), np.minimum(length[order, at], size - before[order, at])


def _ends(start: np.ndarray, length: np.ndarray, bars: int) -> Iterator[tuple[np.ndarray | slice, np.ndarray, int]]:
    """Prefix sums that a block adds (+1) or takes away (-1); a block that passes the last bar goes on at the first."""
    end = start + length
    over = end > bars
    yield slice(None), start, -1
    yield slice(None), np.where(over, end - bars, end), 1
    yield over, np.full(int(over.sum()), bars), 1


def _blocks(bars: int, block: int, repetitions: int) -> Iterator[tuple[int, int, int, int]]:
    """(segment, its size, first and last repetition) in portions a task can hold."""
    for segment, begin in enumerate(range(0, bars, SEGMENT)):
        size = min(SEGMENT, bars - begin)
        step = max(1, min(repetitions, AT_ONCE * block // max(1, size)))
        for first in range(1, repetitions + 1, step):
            yield segment, size, first, min(first + step, repetitions + 1)


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", " + more


def _whole(keys: Sequence[str], block: int, repetitions: int, ends: Sequence[float]) -> Callable[[pa.Table], pa.Table]:
    def resample(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bar_no")
        prefix = np.r_[0.0, np.cumsum(rows.column("_log").to_numpy())]
        bars, seed = len(prefix) - 1, rows.column("_seed")[0].as_py()
        totals = np.zeros(repetitions + 1)
        for segment, size, first, last in _blocks(bars, block, repetitions):
            rep, start, length = _draws(seed, segment, size, bars, first, last, block)
            for which, place, sign in _ends(start, length, bars):
                totals += np.bincount(rep[which], sign * prefix[place], repetitions + 1)
        low, high = np.quantile(totals[1:], ends)
        found = {"bars": pa.array([bars]), "total_return": pa.array([prefix[-1]]), "low": pa.array([low]), "high": pa.array([high])}
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in keys}, **found})

    return resample


def bootstrap_interval(
    df: DataFrame, lay: Layout, value: str = "ret", block: int = BLOCK, repetitions: int = REPETITIONS, level: float = 0.95
) -> DataFrame:
    """``bars, total_return, low, high`` per key: the log return and the interval that ``level`` of the new series fall into.

    Reads ``bar_no`` (1, 2, ... per key) and ``value``; a missing return
    counts as none.  Ends are interpolated between repetitions.
    """
    keys, ends = list(lay.keys), ((1 - level) / 2, (1 + level) / 2)
    seed = F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long").alias("_seed")
    log = F.coalesce(F.log1p(value), F.lit(0.0)).alias("_log")
    if lay.chunked:
        return _by_chunks(own_rows(df, lay).select(*lay.groups, "ts", F.lit(True).alias("own"), "bar_no", log), lay, seed, block, repetitions, ends)
    bars = df.select(*keys, "bar_no", log, seed)
    out = _schema(bars, keys, "bars long, total_return double, low double, high double")
    return bars.groupBy(*keys).applyInArrow(_whole(keys, block, repetitions, ends), out)


def _sent(keys: Sequence[str], block: int, chunk_rows: int):
    """Places of one portion of repetitions in one segment, packed per chunk."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("_seed", "segment", "first", "last", "bars")}
                size = min(SEGMENT, row["bars"] - row["segment"] * SEGMENT)
                rep, start, length = _draws(row["_seed"], row["segment"], size, row["bars"], row["first"], row["last"], block)
                codes, bars, adds = [], [], []
                for which, place, sign in _ends(start, length, row["bars"]):
                    used = place > 0        # nothing stands before the first bar
                    bar = place[used] - 1
                    codes.append((rep[which][used] - row["first"]) * chunk_rows + bar % chunk_rows)
                    bars.append(bar // chunk_rows)
                    adds.append(np.full(len(bar), sign > 0))
                code, chunk, add = (np.concatenate(c) for c in (codes, bars, adds))
                order = np.argsort(chunk, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(chunk[order]) > 0, True])
                found = [(int(chunk[order[a]]), _packed(code[order[a:b]], add[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                if found:
                    named = {k: batch.column(k).take(pa.array(np.full(len(found), i))) for k in keys}
                    sent = {"chunk": [c for c, _ in found], "first": [row["first"]] * len(found), "packed": [p for _, p in found]}
                    types = {"chunk": pa.int64(), "first": pa.int32(), "packed": pa.binary()}
                    yield pa.RecordBatch.from_pydict({**named, **{c: pa.array(v, types[c]) for c, v in sent.items()}})

    return draw


def _received(keys: Sequence[str], repetitions: int, chunk_rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def add(rows: pa.Table, places: pa.Table) -> pa.Table:
        prefix = rows.sort_by("bar_no").column("prefix").to_numpy()
        totals = np.zeros(repetitions)
        for first, packed in zip(places.column("first").to_pylist(), places.column("packed"), strict=True):
            code, sign = _unpacked(packed.as_buffer().to_pybytes())
            part = np.bincount(code // chunk_rows, sign * prefix[code % chunk_rows])
            totals[first - 1:first - 1 + len(part)] += part
        return pa.table({**{k: rows.column(k).slice(0, 1) for k in keys}, "parts": pa.array([totals.tolist()], pa.list_(pa.float64()))})

    return add


def _spread(keys: Sequence[str], ends: Sequence[float]) -> Callable[[pa.Table], pa.Table]:
    """The interval from the totals of every repetition, one list per chunk."""

    def add(chunks: pa.Table) -> pa.Table:
        totals = sum(part.values.to_numpy() for part in chunks.column("parts"))
        low, high = np.quantile(totals, ends)
        return pa.table({**{k: chunks.column(k).slice(0, 1) for k in keys}, "low": pa.array([low]), "high": pa.array([high])})

    return add


def _by_chunks(bars: DataFrame, lay: Layout, seed: Column, block: int, repetitions: int, ends: Sequence[float]) -> DataFrame:
    keys = list(lay.keys)
    bars = settle(bars)
    summed = carry_in(
        bars.withColumn("_local", F.sum("_log").over(lay.so_far())), lay, {"_sum": F.sum("_log")},
        lambda chunks, order: chunks.select(*keys, "chunk", F.sum("_sum").over(order.before()).alias("_carry")),
    )
    prefix = summed.select(*keys, "chunk", "bar_no", (F.col("_local") + F.coalesce("_carry", F.lit(0.0))).alias("prefix"))
    whole = settle(bars.groupBy(*keys).agg(F.max("bar_no").alias("bars"), F.sum("_log").alias("total_return")).select("*", seed))
    segments = F.sequence(F.lit(0), F.floor((F.col("bars") - 1) / SEGMENT).cast("int"))
    portions = whole.withColumn("segment", F.explode(segments)).withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(repetitions), F.lit(TOGETHER))))
    portions = portions.withColumn("last", F.least(F.col("first") + TOGETHER, F.lit(repetitions + 1)))
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = portions.repartition(tasks, *keys, "segment", "first").mapInArrow(
        _sent(keys, block, lay.chunk_rows), _schema(bars, keys, "chunk long, first int, packed binary")
    )
    parts = prefix.groupBy(*keys, "chunk").cogroup(places.groupBy(*keys, "chunk")).applyInArrow(
        _received(keys, repetitions, lay.chunk_rows), _schema(bars, keys, "parts array<double>")
    )
    interval = parts.groupBy(*keys).applyInArrow(_spread(keys, ends), _schema(bars, keys, "low double, high double"))
    return whole.join(interval, keys).select(*keys, "bars", "total_return", "low", "high")
