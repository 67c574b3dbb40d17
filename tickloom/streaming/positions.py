"""Positions on a stream of signals, one small state per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "symbol string, ts timestamp, price double, pos int"
STATE = "pos int, ts array<long>, price array<double>, entry array<boolean>, exit array<boolean>"


def _after(start: int, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Position after each row: an entry sets it, an exit clears it, both at once turn it."""
    switch = entry != leave
    last = np.maximum.accumulate(np.where(switch, np.arange(len(entry)), -1))
    flips = np.cumsum(entry & leave)
    known = last >= 0
    base = np.where(known, entry[last], start)
    return (base + flips - np.where(known, flips[last], 0)) % 2


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds rows until the watermark has passed them, then applies them in order.

    Rows may arrive in any order within the watermark delay; only those of
    that span are kept in the state.
    """
    pos, *held = state.get if state.exists else (0, [], [], [], [])
    frames = [pd.DataFrame(dict(zip(("ts", "price", "entry", "exit"), held)))]
    for pdf in batches:
        ts = pdf["ts"].astype("datetime64[us]").astype("int64")
        frames.append(pd.DataFrame({"ts": ts, "price": pdf["price"], "entry": pdf["entry"], "exit": pdf["exit"]}))
    rows = pd.concat([f for f in frames if len(f)] or frames[:1]).sort_values("ts", kind="stable")
    ripe = rows["ts"] <= state.getCurrentWatermarkMs() * 1000
    done, rest = rows[ripe], rows[~ripe]

    taken = _after(pos, done["entry"].to_numpy(bool), done["exit"].to_numpy(bool))
    state.update((int(taken[-1]) if len(taken) else pos, *[rest[c].tolist() for c in ("ts", "price", "entry", "exit")]))
    if len(rest):
        earliest = int(rest["ts"].min()) // 1000
        state.setTimeoutTimestamp(max(earliest, state.getCurrentWatermarkMs() + 1))
    if len(taken):
        yield pd.DataFrame({
            "symbol": key[0], "ts": pd.to_datetime(done["ts"].to_numpy(), unit="us"),
            "price": done["price"].to_numpy(), "pos": taken.astype("int32"),
        })


def stream_positions(signals: DataFrame) -> DataFrame:
    """symbol, ts, price, pos after each signal row; ``signals`` carries a watermark on ts.

    Feed it bars, not raw ticks: the state then holds one row per open bar
    however many ticks a hot symbol has.
    """
    return signals.groupBy("symbol").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
