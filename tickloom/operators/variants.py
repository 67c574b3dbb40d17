"""The rules of the catalogue with other parameters, and sweeps over them.

A variant is a rule with values for some of its parameters.  Its indicators
are computed next to the bars, its entry and exit kept as two columns; the
variants of a sweep then become rows, like the rules of a batch run.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.compare import above, at_least, at_most, below
from tickloom.operators import indicators as ind
from tickloom.operators.positions import Account, with_equity, with_fills, with_position, with_returns
from tickloom.plans.layout import Layout, spread_over

Built = tuple[DataFrame, Sequence[str], Column, Column]     # bars, columns that must be known, entry, exit

PARAMETERS: dict[str, dict[str, float]] = {}
BUILDERS: dict[str, Callable[..., Built]] = {}


def builder(*names: str, **defaults: float) -> Callable[[Callable[..., Built]], Callable[..., Built]]:
    def add(build: Callable[..., Built]) -> Callable[..., Built]:
        for name in names:
            PARAMETERS[name], BUILDERS[name] = defaults, build
        return build

    return add


@dataclass(frozen=True)
class Variant:
    strategy: str
    params: tuple[tuple[str, float], ...] = ()

    @classmethod
    def of(cls, strategy: str, **params: float) -> Variant:
        """Parameters that are left out keep their usual value; one the rule does not have is an error."""
        unknown = set(params) - set(PARAMETERS[strategy])
        if unknown:
            raise ValueError(f"{strategy} has no {', '.join(sorted(unknown))}")
        return cls(strategy, tuple({**PARAMETERS[strategy], **params}.items()))

    @property
    def label(self) -> str:
        return json.dumps(dict(self.params))


def grid(strategy: str, **choices: Iterable[float]) -> list[Variant]:
    """Every combination of the choices."""
    names = list(choices)
    return [Variant.of(strategy, **dict(zip(names, values, strict=True))) for values in itertools.product(*choices.values())]


def random_search(strategy: str, n: int, seed: int, **choices: Sequence[float]) -> list[Variant]:
    """``n`` different combinations, drawn at random; all of them where there are fewer."""
    every = grid(strategy, **choices)
    return random.Random(seed).sample(every, min(n, len(every)))


# ---- what each rule reads ---------------------------------------------------


def _on_cross(df: DataFrame, lay: Layout, difference: Column) -> Built:
    return ind.with_crosses(df, lay, {"_x": difference}), ["_x"], F.col("_x") == 1, F.col("_x") == -1


def _channel(df: DataFrame, lay: Layout, period: int) -> DataFrame:
    """Highest high and lowest low of the bars before."""
    df = ind.with_extremes(df, lay, period)
    return df.withColumns({"_top": ind.bars_back(lay, 1, f"hh{period}"), "_floor": ind.bars_back(lay, 1, f"ll{period}")})


@builder("GoldenCross", "SmaCross", fast=50, slow=200)
def _sma_cross(df: DataFrame, lay: Layout, fast: int, slow: int) -> Built:
    df = ind.with_smas(df, lay, fast, slow)
    return _on_cross(df, lay, F.col(f"sma{fast}") - F.col(f"sma{slow}"))


@builder("EmaCross", fast=12, slow=26)
def _ema_cross(df: DataFrame, lay: Layout, fast: int, slow: int) -> Built:
    return _on_cross(ind.with_ema(df, lay, fast, slow), lay, F.col(f"ema{fast}") - F.col(f"ema{slow}"))


@builder("MacdSignal", fast=12, slow=26, signal=9)
def _macd(df: DataFrame, lay: Layout, fast: int, slow: int, signal: int) -> Built:
    return _on_cross(ind.with_macd(df, lay, fast, slow, signal), lay, F.col("macd") - F.col("macd_signal"))


@builder("Rsi2", period=2, trend=200, low=10, high=70)
def _rsi(df: DataFrame, lay: Layout, period: int, trend: int, low: float, high: float) -> Built:
    df = ind.with_rsi(ind.with_smas(df, lay, trend), lay, period)
    value = F.col(f"rsi{period}")
    df = ind.with_crosses(df, lay, {"_low": value - low, "_high": value - high})
    mean = f"sma{trend}"
    return df, [mean, "_low", "_high"], above(F.col("close"), F.col(mean)) & (F.col("_low") == -1), F.col("_high") != 0


@builder("RsiStochCombo", period=2, stochastic=14, low=15, high=85)
def _rsi_stochastic(df: DataFrame, lay: Layout, period: int, stochastic: int, low: float, high: float) -> Built:
    df = ind.with_stochastic(ind.with_extremes(df, lay, stochastic), lay, stochastic)
    df = ind.with_rsi(df, lay, period)
    value = F.col(f"rsi{period}")
    df = ind.with_crosses(df, lay, {"_low": value - low, "_high": value - high})
    entry = below(value, low) & below(F.col("sto_k"), low)
    return df, [f"rsi{period}", "sto_k", "_low", "_high"], entry, above(value, high) | (F.col("_high") != 0)


@builder("BollingerBreakout", period=20, deviations=2.0)
def _bollinger(df: DataFrame, lay: Layout, period: int, deviations: float) -> Built:
    df = ind.with_smas(df, lay, period).withColumn("_std", ind.rolling_std(lay, period))
    mean = F.col(f"sma{period}")
    return df, [f"sma{period}", "_std"], above(F.col("close"), mean + deviations * F.col("_std")), below(F.col("close"), mean)


@builder("MaEnvelope", period=50, share=0.02)
def _envelope(df: DataFrame, lay: Layout, period: int, share: float) -> Built:
    mean = F.col(f"sma{period}")
    df = ind.with_smas(df, lay, period)
    return df, [f"sma{period}"], above(F.col("close"), mean * (1 + share)), below(F.col("close"), mean * (1 - share))


@builder("DonchianTurtle", period=20)
def _donchian(df: DataFrame, lay: Layout, period: int) -> Built:
    df = _channel(df, lay, period)
    return df, ["_top", "_floor"], at_least(F.col("close"), F.col("_top")), at_most(F.col("close"), F.col("_floor"))


@builder("AdxBreakout", period=14, channel=20, level=25)
def _adx(df: DataFrame, lay: Layout, period: int, channel: int, level: float) -> Built:
    df = ind.with_adx(_channel(df, lay, channel), lay, period)
    strong = above(F.col(f"adx{period}"), level)
    return df, ["_top", "_floor", f"adx{period}"], at_least(F.col("close"), F.col("_top")) & strong, at_most(F.col("close"), F.col("_floor"))


@builder("KeltnerBreakout", period=20, factor=1.5)
def _keltner(df: DataFrame, lay: Layout, period: int, factor: float) -> Built:
    df = ind.with_atr(ind.with_ema(df, lay, period), lay, period)
    middle = F.col(f"ema{period}")
    entry = above(F.col("close"), middle + factor * F.col(f"atr{period}"))
    return df, [f"ema{period}", f"atr{period}"], entry, below(F.col("close"), middle)


@builder("AtrTrailingTrend", period=20, highest=20, factor=3.0)
def _trailing(df: DataFrame, lay: Layout, period: int, highest: int, factor: float) -> Built:
    df = ind.with_atr(ind.with_extremes(df, lay, highest), lay, period)
    stop = F.col(f"hh{highest}") - factor * F.col(f"atr{period}")
    return df, [f"hh{highest}", f"atr{period}"], above(F.col("close"), stop), below(F.col("close"), stop)


@builder("AtrChannelReversion", period=30, factor=1.8)
def _atr_reversion(df: DataFrame, lay: Layout, period: int, factor: float) -> Built:
    df = ind.with_atr(ind.with_vwap(df, lay), lay, period)
    entry = below(F.col("close"), F.col("vwap") - factor * F.col(f"atr{period}"))
    return df, ["vwap", f"atr{period}"], entry, at_least(F.col("close"), F.col("vwap"))


@builder("VwapReversion", period=30, deviations=1.5)
def _vwap_reversion(df: DataFrame, lay: Layout, period: int, deviations: float) -> Built:
    df = ind.with_vwap(df, lay).withColumn("_std", ind.rolling_std(lay, period))
    entry = below(F.col("close"), F.col("vwap") - deviations * F.col("_std"))
    return df, ["vwap", "_std"], entry, above(F.col("close"), F.col("vwap"))


@builder("IchimokuTrend", fast=9, slow=26, cloud=52)
def _ichimoku(df: DataFrame, lay: Layout, fast: int, slow: int, cloud: int) -> Built:
    df = ind.with_extremes(df, lay, fast, slow, cloud)
    df = df.withColumns({f"_mid{n}": (F.col(f"hh{n}") + F.col(f"ll{n}")) / 2 for n in (fast, slow, cloud)})
    back = {n: ind.bars_back(lay, slow, f"_mid{n}") for n in (fast, slow, cloud)}
    df = df.withColumns({"_a": (back[fast] + back[slow]) / 2, "_b": back[cloud]})
    df = ind.with_crosses(df, lay, {"_x": F.col(f"_mid{fast}") - F.col(f"_mid{slow}")})
    over = above(F.col("close"), F.greatest("_a", "_b"))
    return df, ["_a", "_b", "_x"], over & (F.col("_x") == 1), (F.col("_x") == -1) | ~over


@builder("TwelveMonthMomentum", bars=252)
def _momentum(df: DataFrame, lay: Layout, bars: int) -> Built:
    df = df.withColumn("_then", ind.bars_back(lay, bars))
    return df, ["_then"], above(F.col("close"), F.col("_then")), at_most(F.col("close"), F.col("_then"))


@builder("MonthlyRotator", long=252, short=126)
def _rotator(df: DataFrame, lay: Layout, long: int, short: int) -> Built:
    df = df.withColumns({"_long": ind.bars_back(lay, long), "_short": ind.bars_back(lay, short), "_new": ind.month_change(lay)})
    up = above(F.col("close"), F.col("_long")) & above(F.col("close"), F.col("_short"))
    return df, ["_long", "_short", "_new"], F.col("_new") & up, F.col("_new") & ~up


@builder("BuyAndHold")
def _hold(df: DataFrame, lay: Layout) -> Built:
    return df, ["close"], F.lit(True), F.lit(False)


# ---- signals and sweeps -----------------------------------------------------


def with_variant(df: DataFrame, lay: Layout, variant: Variant, entry: str, leave: str) -> DataFrame:
    """Adds entry and exit of one variant, false wherever one of its inputs is unknown."""
    kept = df.columns
    built, needs, enter, exit_ = BUILDERS[variant.strategy](df, lay, **dict(variant.params))
    ready = reduce(Column.__and__, [F.col(n).isNotNull() for n in needs])
    flags = {entry: F.coalesce(ready & enter, F.lit(False)), leave: F.coalesce(ready & exit_, F.lit(False))}
    return built.withColumns(flags).select(*kept, entry, leave)


def variant_signals(df: DataFrame, lay: Layout, variants: Sequence[Variant], account: Account = Account()) -> tuple[DataFrame, Layout]:
    """One row per bar and variant: strategy, params (JSON), entry, exit and the fills."""
    df = with_fills(df, lay, account)
    for i, v in enumerate(variants):
        df = with_variant(df, lay, v, f"_entry{i}", f"_exit{i}")
    kept = ["symbol", "ts", "bar_no", "close", "buy_fill", "sell_fill", "next_ts", "next_close", *(["chunk", "own"] if lay.chunked else [])]
    rows = F.array(*[
        F.struct(F.lit(v.strategy).alias("strategy"), F.lit(v.label).alias("params"), F.col(f"_entry{i}").alias("entry"), F.col(f"_exit{i}").alias("exit"))
        for i, v in enumerate(variants)
    ])
    long = df.select(*kept, rows.alias("_signals")).select(*kept, F.inline("_signals"))
    if lay.spread and len(variants) > 1:
        long = spread_over(long, *lay.keys, "strategy", "params")
    return long, lay.per("strategy", "params")


def sweep(df: DataFrame, lay: Layout, variants: Sequence[Variant], account: Account = Account()) -> tuple[DataFrame, Layout]:
    """Bars with position, equity and returns per symbol and variant."""
    df, lay = variant_signals(df, lay, variants, account)
    return with_returns(with_equity(with_position(df, lay, account), lay, account), lay, account), lay


def total_returns(df: DataFrame, account: Account = Account()) -> DataFrame:
    """symbol, strategy, params, total_return (log)."""
    return df.groupBy("symbol", "strategy", "params").agg(
        F.log(F.max_by("equity", "bar_no") / account.capital).alias("total_return")
    )


def best_variants(df: DataFrame, account: Account = Account()) -> DataFrame:
    """Per symbol the variant with the highest total return; of equal ones the first by its JSON."""
    order = F.struct((-F.round("total_return", 9)).alias("r"), "strategy", "params")
    return total_returns(df, account).groupBy("symbol").agg(F.min_by(F.struct("strategy", "params", "total_return"), order).alias("_b")).select("symbol", "_b.*")
