"""Indicators on a stream of bars, carried by a few small states per symbol.

Bars may arrive in any order within the watermark delay.  They wait in a map
until event time has passed them; a timer then applies them in order to the
states of the exponential means, the mean true range, the volume-weighted
price and the cross.  A stream can go on from where a table ends: the states
after the last bar of every symbol are its initial state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.compare import EPS, side
from tickloom.operators import indicators as ind
from tickloom.plans.layout import Layout, own_rows
from tickloom.session import settle
from tickloom.streaming.bars import run_to_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = "symbol string, ts timestamp, close double, ema_fast double, ema_slow double, atr double, vwap double, cross int"
BAR = "high double, low double, close double, volume long"
MEAN = "seen long, total double, value double"
STATE = (
    "symbol string, fast_seen long, fast_total double, fast_value double, slow_seen long, slow_total double, slow_value double, "
    "atr_seen long, atr_total double, atr_value double, close double, traded double, volume long, side int"
)


class _Mean:
    """A recursive mean seeded with the plain mean of its first ``period`` values."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, period: int, keep: float) -> None:
        self.state, self.period, self.keep = handle.getValueState(name, MEAN), period, keep

    def load(self) -> None:
        self.seen, self.total, self.value = self.state.get() if self.state.exists() else (0, 0.0, None)

    def add(self, x: float) -> float | None:
        self.seen += 1
        if self.seen <= self.period:
            self.total += x
            self.value = self.total / self.period if self.seen == self.period else None
        else:
            self.value = self.keep * self.value + (1 - self.keep) * x
        return self.value

    def save(self) -> None:
        self.state.update((self.seen, self.total, self.value))


class IndicatorProcessor(StatefulProcessor):
    def __init__(self, fast: int = 12, slow: int = 26, atr: int = 14) -> None:
        self.periods = fast, slow, atr

    def init(self, handle: StatefulProcessorHandle) -> None:
        fast, slow, atr = self.periods
        self.handle = handle
        self.fast = _Mean(handle, "fast", fast, 1 - 2 / (fast + 1))
        self.slow = _Mean(handle, "slow", slow, 1 - 2 / (slow + 1))
        self.atr = _Mean(handle, "atr", atr, 1 - 1 / atr)
        self.last = handle.getValueState("last", "close double, side int")
        self.sums = handle.getValueState("sums", "traded double, volume long")
        self.waiting = handle.getMapState("waiting", "us long", BAR)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        known = lambda v: None if pd.isna(v) else v
        for name in ("fast", "slow", "atr"):
            value = known(row[f"{name}_value"])
            getattr(self, name).state.update((int(row[f"{name}_seen"]), float(row[f"{name}_total"]), None if value is None else float(value)))
        self.last.update((float(row["close"]), int(row["side"])))
        self.sums.update((float(row["traded"]), int(row["volume"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            for us, high, low, close, volume in zip(at, pdf["high"], pdf["low"], pdf["close"], pdf["volume"], strict=True):
                self.waiting.updateValue((int(us),), (float(high), float(low), float(close), int(volume)))
                self.handle.registerTimer(max(-(-int(us) // 1000), passed + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ripe = timerValues.getCurrentWatermarkInMs() * 1000
        bars = sorted((k[0], *v) for k, v in self.waiting.iterator() if k[0] <= ripe)
        if bars:
            yield self._advanced(key[0], bars)
            for us, *_ in bars:
                self.waiting.removeKey((us,))

    def _advanced(self, symbol: str, bars: list[tuple]) -> pd.DataFrame:
        means = self.fast, self.slow, self.atr
        for mean in means:
            mean.load()
        before, last_side = self.last.get() if self.last.exists() else (None, 0)
        traded, volume_so_far = self.sums.get() if self.sums.exists() else (0.0, 0)
        out = []
        for us, high, low, close, volume in bars:
            fast, slow = self.fast.add(close), self.slow.add(close)
            atr = None if before is None else self.atr.add(max(high, before) - min(low, before))
            traded, volume_so_far = traded + close * volume, volume_so_far + volume
            cross = None
            if fast is not None and slow is not None:
                now = (fast - slow > EPS) - (fast - slow < -EPS)
                cross = now if now and now == -last_side else 0
                last_side = now or last_side
            out.append((symbol, us, close, fast, slow, atr, traded / volume_so_far if volume_so_far else close, cross))
            before = close
        for mean in means:
            mean.save()
        self.last.update((before, last_side))
        self.sums.update((traded, volume_so_far))
        table = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        table["ts"] = pd.to_datetime(table["ts"], unit="us")
        return table.astype({"ema_fast": float, "ema_slow": float, "atr": float, "cross": "Int32"})

    def close(self) -> None:
        pass


def indicator_states(df: DataFrame, lay: Layout, fast: int = 12, slow: int = 26, atr: int = 14) -> DataFrame:
    """The states after the last bar of every symbol of a table; bars as :func:`lay_out` gives them."""
    df = ind.with_atr(ind.with_ema(df, lay, fast, slow), lay, atr)
    df = ind.with_moves(df, lay)
    df = own_rows(df, lay)
    last = F.max_by
    gap = side(F.col(f"ema{fast}") - F.col(f"ema{slow}"))
    terms = {"bars": F.count(F.lit(1)), "close": last("close", "bar_no")}
    for name, column, period, value, first in (("fast", f"ema{fast}", fast, "close", 1), ("slow", f"ema{slow}", slow, "close", 1), ("atr", f"atr{atr}", atr, "true_range", 2)):
        terms[f"{name}_total"] = F.coalesce(F.sum(F.when(F.col("bar_no") < first + period, F.col(value))), F.lit(0.0))
        terms[f"{name}_value"] = last(column, "bar_no")
    terms |= {
        "traded": F.sum(F.col("close") * F.col("volume")), "volume": F.sum("volume"),
        "side": F.coalesce(F.max_by(gap, F.when(gap != 0, F.col("bar_no"))), F.lit(0)),
    }
    table = df.groupBy("symbol").agg(*[c.alias(n) for n, c in terms.items()])
    table = table.withColumns({"fast_seen": F.col("bars"), "slow_seen": F.col("bars"), "atr_seen": F.col("bars") - 1})
    return table.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STATE.split(", ")])


def stream_indicators(bars: DataFrame, states: DataFrame | None = None, fast: int = 12, slow: int = 26, atr: int = 14) -> DataFrame:
    """Indicators of every bar; ``bars`` has symbol, ts (with a watermark), high, low, close, volume.

    ``states`` are those of an earlier table; symbols it does not have start
    anew.  Bars older than the watermark are dropped before they get here; a
    bar that comes twice counts once, the later one.
    """
    first = settle(states).groupBy("symbol") if states is not None else None
    late = F.col("ts").isNotNull()
    return bars.filter(late).groupBy("symbol").transformWithStateInPandas(
        IndicatorProcessor(fast, slow, atr), OUTPUT, "append", "eventtime", first
    )


def run_stateful(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Runs the stream over all there is with the state store that timers and maps need; the table it wrote."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return spark.read.schema(stream.schema).parquet(run_to_folder(stream, name, out))
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
