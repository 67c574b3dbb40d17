"""Packing token sequences by a configuration linear program.

The only thing packing depends on is how many pieces there are of each length,
a table of at most ``capacity`` rows.  Over it a covering program is solved:
choose how often to use each configuration (a multiset of lengths that fits one
sequence) so that every length is covered.  Multiplicative weights put a price
on each length, raise it where cover lags behind and lower it where cover is
ahead; a knapsack dynamic program finds the configuration of highest price.
The fractional solution is rounded down; while that leaves more than a quarter of
the pieces it is solved again, unless a level places less than an eighth of them, and the
pieces left are placed by best fit.  The plan is a list of
configurations with counts; pieces take their place in it by their rank among
the pieces of their length, so no task ever sees more than its share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.rows import numbered, sliced
from tickloom.llm.words import encoder
from tickloom.session import settle

CAPACITY = 4_096
RANK_ROWS = 100_000         # pieces of one length ranked by one task
Config = tuple[tuple[int, int], ...]        # (length, how often)

PIECES = "row_id long, doc_id long, piece int, start long, length int, ids_crc32 long"


# --- the program over the histogram -------------------------------------------------------------

def price_knapsack(lengths: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each length so that the summed price is highest within ``capacity``.

    Each length may be taken up to ``most`` times: it is offered in bundles of
    1, 2, 4, ... pieces, and the table over room is kept for the way back.  Lengths
    come in order of their price for their size.  It ends early only when no
    split of the capacity between the lengths seen and any of those to come, all
    taken at the price for size of the next one, is worth more than the best found.
    """
    order = np.argsort(-prices / lengths, kind="stable")
    worth = (prices / lengths)[order]
    shortest = np.minimum.accumulate(lengths[order][::-1])[::-1]
    room = np.arange(capacity + 1)
    best = np.zeros(capacity + 1)
    bundles: list[tuple[int, int, int]] = []
    taken: list[np.ndarray] = []
    for i, k in enumerate(order.tolist()):
        if i and i % 8 == 0:        # nothing is worth more for its size than this length is
            r = int(shortest[i])
            if r > capacity or (best[: capacity + 1 - r] + worth[i] * room[: r - 1 if r else None: -1]).max() <= best[capacity] + 1e-12:
                break
        left = min(int(most[k]), capacity // int(lengths[k]))
        size = 1
        while left > 0:
            take = min(size, left)
            weight = take * int(lengths[k])
            offered = best[: capacity + 1 - weight] + take * prices[k]
            better = np.zeros(capacity + 1, bool)
            better[weight:] = offered > best[weight:] + 1e-12
            best[weight:] = np.where(better[weight:], offered, best[weight:])
            bundles.append((k, take, weight))
            taken.append(better)
            left, size = left - take, size * 2
    counts = np.zeros(len(lengths), np.int64)
    at = capacity
    for (k, take, weight), better in zip(reversed(bundles), reversed(taken), strict=True):
        if better[at]:
            counts[k] += take
            at -= weight
    return counts


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 240) -> list[tuple[Config, int]]:
    """Configurations and how often to use each; together they hold every piece exactly once.

    ``rounds`` bounds the pricings of a level.  The program is solved with
    cover up to the demand, with cover beyond it, which finds prices far from
    the lengths, and best fit is run alone; the plan with fewest sequences is
    taken, whatever the size of the histogram.  A plan that meets the volume
    bound ends the search, as none can have fewer.
    """
    bound = -(-sum(k * n for k, n in histogram.items()) // capacity)
    count = lambda plan: sum(n for _, n in plan)
    plans: list[list[tuple[Config, int]]] = []
    for beyond in (False, True):
        plans.append(_rounded(histogram, capacity, rounds, beyond))
        if count(plans[-1]) == bound:
            return plans[-1]
    return min([*plans, best_fit(histogram, capacity)], key=count)


def _rounded(histogram: dict[int, int], capacity: int, rounds: int, beyond: bool) -> list[tuple[Config, int]]:
    """Levels of fractional solution and rounding until at most a quarter is left or one places less than an eighth, then best fit."""
    plan: dict[Config, int] = {}
    left = {k: n for k, n in histogram.items() if n > 0}
    enough = max(400, sum(left.values()) // 4)
    if beyond:
        enough = min(enough, sum(left.values()) // 4)
    while sum(left.values()) > enough:
        used = _level(left, capacity, rounds, beyond)
        if sum(n * k for config, n in used for _, k in config) * 8 < sum(left.values()):
            break
        for config, n in used:
            plan[config] = plan.get(config, 0) + n
            for length, k in config:
                left[length] -= k * n
        left = {k: n for k, n in left.items() if n}
    for config, n in best_fit(left, capacity):
        plan[config] = plan.get(config, 0) + n
    return list(plan.items())


def _level(histogram: dict[int, int], capacity: int, rounds: int, beyond: bool) -> list[tuple[Config, int]]:
    """Fractional cover by multiplicative weights, rounded down.

    The price of a length starts at its share of the capacity (the prices of
    the volume bound) and falls exponentially with how far its cover is ahead
    of the length that is covered least.
    """
    lengths = np.array(sorted(histogram, reverse=True))
    demand = np.array([histogram[k] for k in lengths], float)
    bins = max(1.0, float(lengths @ demand) / capacity)
    cover = np.zeros(len(lengths))          # in demands
    step, rate = max(1.0, bins / rounds), 12.0 if beyond else 4.0
    used: dict[Config, float] = {}
    for _ in range(2 * rounds):
        open_ = np.ones(len(lengths), bool) if beyond else cover < 1 - 1e-9
        if not open_.any() or (beyond and cover.min() >= 2):
            break
        weights = np.exp(-rate * (cover - cover[open_].min()))
        index = np.flatnonzero(open_)
        room = demand if beyond else demand * (1 - cover)
        prices = weights * lengths / capacity
        counts = np.zeros(len(lengths))
        counts[index] = price_knapsack(lengths[index], prices[index], np.maximum(1, np.floor(room[index])).astype(np.int64), capacity)
        some = counts > 0
        amount = float((room[some] / counts[some]).min())
        amount = min(step, amount / 8 if beyond else amount)
        config = tuple((int(lengths[k]), int(counts[k])) for k in np.flatnonzero(some))
        used[config] = used.get(config, 0.0) + amount
        cover += amount * counts / demand
    scale = 1 / max(1.0, float(cover.min())) if beyond else 1.0
    out, left = [], dict(histogram)
    for config, x in sorted(used.items(), key=lambda c: -c[1] * sum(length * k for length, k in c[0])):
        n = min(int(x * scale + 1e-9), *[left[length] // k for length, k in config])
        if n > 0:
            out.append((config, n))
            for length, k in config:
                left[length] -= k * n
    return out


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit, longest first, over (length, count) bundles.

    Of the sequences with the least room that fits, each takes as many pieces of
    the length as it holds before the next one gets any, so sequences that are
    filled alike are moved together: the work depends on the number of lengths,
    not on that of the pieces.
    """
    by_room: list[list[tuple[Config, int]]] = [[] for _ in range(capacity + 1)]     # (filled with, how many sequences)
    rooms = np.zeros(capacity + 1, bool)

    def add(config: Config, length: int, each: int, n: int, room: int) -> None:
        by_room[room - each * length].append((config + ((length, each),), n))
        rooms[room - each * length] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                config, there = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                room, config, there = capacity, (), left
            each = room // length
            full = min(there, left // each)
            if full:
                add(config, length, each, full, room)
            left -= each * full
            there -= full
            if there and left:      # the last ones, in one sequence
                add(config, length, left, 1, room)
                left, there = 0, there - 1
            if there and config:
                by_room[room].append((config, there))
                rooms[room] = True
    plan: dict[Config, int] = {}
    for found in by_room:
        for config, n in found:
            plan[config] = plan.get(config, 0) + n
    return list(plan.items())


# --- pieces and their places --------------------------------------------------------------------

def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids; a null text is empty and has the end id only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for rows in sliced(batches):
            out: list[tuple] = []
            for row, doc, text in zip(*[rows.column(c).to_pylist() for c in ("row_id", "doc_id", "text")], strict=True):
                ids = enc.packed(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((row, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return numbered(docs, doc_id=id_column, text=text_column).mapInArrow(cut, PIECES)


def ranked(pieces: DataFrame, counts: dict[int, int], rank_rows: int = RANK_ROWS) -> DataFrame:
    """0-based ``rank`` among the pieces of a length; lengths with many pieces are dealt over several tasks."""
    slices = F.coalesce(_lookup({k: -(-n // rank_rows) for k, n in counts.items() if n > rank_rows}, "length"), F.lit(1))
    dealt = pieces.withColumn("_slice", F.pmod(F.xxhash64("row_id", "piece"), slices))
    along = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_slice", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "row_id")
    return (
        dealt.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_slice"])
        .withColumn("rank", F.col("_start") + F.col("_place"))
        .drop("_slice", "_start", "_place")
    )


def _lookup(values: dict[int, int], column: str):
    if not values:
        return F.lit(None).cast("int")
    pairs = [F.lit(x) for k, n in values.items() for x in (k, n)]
    return F.create_map(*pairs)[F.col(column)]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` ids without gaps.

    The histogram of lengths (at most ``capacity`` rows) and the plan over it
    are all that the driver sees.  The plan is broadcast as arrays: for each
    length, the ranks at which its slots in a configuration begin.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = solve(histogram, capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}     # length -> (first rank, per sequence, first sequence, offset)
    seen: dict[int, int] = {}
    sequence = 0
    for config, n in plan:
        at = 0
        for length, k in config:
            slots.setdefault(length, []).append((seen.get(length, 0), k, sequence, at))
            seen[length] = seen.get(length, 0) + k * n
            at += k * length
        sequence += n
    arrays = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            found, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                table = arrays.value[int(one)]
                slot = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                k, nth = np.divmod(rank[mine] - slot[:, 0], slot[:, 1])
                found[mine], offset[mine] = slot[:, 2] + k, slot[:, 3] + nth * one
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found), pa.array(offset)], [*rows.schema.names, "sequence_id", "offset"])

    names = [f.split()[0] for f in PIECES.split(", ")]
    return ranked(pieces, histogram).select(*names, "rank").mapInArrow(place, f"{PIECES}, rank long, sequence_id long, offset long").drop("rank")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes, cuts and packs: one row per piece.

    Only documents longer than ``capacity`` ids are cut.  Null and empty texts
    have the end id alone; rows with null or repeated ids are packed each; an
    empty table gives no row; other columns are not read.
    """
    return pack(settle(cut_pieces(docs, tokenizer, end_id, capacity, id_column, text_column)), capacity).drop("row_id")
