"""The rule catalogue: entry and exit predicates over indicator columns.

A rule is a function without arguments that returns the columns it needs and
its two predicates.  ``register`` adds a user's rule; nothing else has to know
about it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.compare import above, apart, at_least, at_most, below


@dataclass(frozen=True)
class Signal:
    needs: tuple[str, ...]      # evaluated only where all of these are known
    entry: Column
    exit: Column


RULES: dict[str, Callable[[], Signal]] = {}


def register(name: str) -> Callable[[Callable[[], Signal]], Callable[[], Signal]]:
    def add(rule: Callable[[], Signal]) -> Callable[[], Signal]:
        if name in RULES:
            raise ValueError(f"rule {name!r} exists")
        RULES[name] = rule
        return rule

    return add


def _cross(column: str, *, up: bool) -> Column:
    return F.col(column) == (1 if up else -1)


def _cross_rule(column: str) -> Signal:
    return Signal((column,), _cross(column, up=True), _cross(column, up=False))


def close() -> Column:
    return F.col("close")


@register("AdxBreakout")
def adx_breakout() -> Signal:
    return Signal(
        ("channel_high", "channel_low", "adx14"),
        at_least(close(), F.col("channel_high")) & above(F.col("adx14"), 25),
        at_most(close(), F.col("channel_low")),
    )


@register("AtrChannelReversion")
def atr_channel_reversion() -> Signal:
    return Signal(
        ("vwap", "atr30"),
        below(close(), F.col("vwap") - 1.8 * F.col("atr30")),
        at_least(close(), F.col("vwap")),
    )


@register("AtrTrailingTrend")
def atr_trailing_trend() -> Signal:
    stop = F.col("high20") - 3.0 * F.col("atr20")
    return Signal(("high20", "atr20"), above(close(), stop), below(close(), stop))


@register("BollingerBreakout")
def bollinger_breakout() -> Signal:
    top = F.col("sma20") + 2.0 * F.col("std20")
    return Signal(("sma20", "std20"), above(close(), top), below(close(), F.col("sma20")))


@register("BuyAndHold")
def buy_and_hold() -> Signal:
    return Signal(("close",), F.lit(True), F.lit(False))


@register("DonchianTurtle")
def donchian_turtle() -> Signal:
    return Signal(
        ("channel_high", "channel_low"),
        at_least(close(), F.col("channel_high")),
        at_most(close(), F.col("channel_low")),
    )


@register("EmaCross")
def ema_cross() -> Signal:
    return _cross_rule("cross_ema")


@register("GoldenCross")
def golden_cross() -> Signal:
    return _cross_rule("cross_sma")


@register("IchimokuTrend")
def ichimoku_trend() -> Signal:
    over_cloud = above(close(), F.greatest("span_a", "span_b"))
    return Signal(
        ("span_a", "span_b", "cross_tenkan"),
        over_cloud & _cross("cross_tenkan", up=True),
        _cross("cross_tenkan", up=False) | ~over_cloud,
    )


@register("KeltnerBreakout")
def keltner_breakout() -> Signal:
    return Signal(
        ("ema20", "atr20"),
        above(close(), F.col("ema20") + 1.5 * F.col("atr20")),
        below(close(), F.col("ema20")),
    )


@register("MaEnvelope")
def ma_envelope_rule() -> Signal:
    return Signal(
        ("sma50",),
        above(close(), F.col("sma50") * (1 + 0.02)),
        below(close(), F.col("sma50") * (1 - 0.02)),
    )


@register("MacdSignal")
def macd_signal() -> Signal:
    return _cross_rule("cross_macd")


@register("MonthlyRotator")
def monthly_rotator() -> Signal:
    """Looks only at the first bar of a month; needs a full 252 bars behind it."""
    long_up = above(close(), F.col("close_252"))
    short_up = above(close(), F.col("close_126"))
    return Signal(
        ("close_252", "close_126", "new_month"),
        F.col("new_month") & long_up & short_up,
        F.col("new_month") & ~(long_up & short_up),
    )


@register("Rsi2")
def rsi2() -> Signal:
    """Leaves on a cross of 70 in either direction."""
    return Signal(
        ("sma200", "cross_rsi10", "cross_rsi70"),
        above(close(), F.col("sma200")) & _cross("cross_rsi10", up=False),
        F.col("cross_rsi70") != 0,
    )


@register("RsiStochCombo")
def rsi_stoch_combo() -> Signal:
    return Signal(
        ("rsi2", "sto_k", "cross_rsi85", "cross_rsi15"),
        below(F.col("rsi2"), 15) & below(F.col("sto_k"), 15),
        above(F.col("rsi2"), 85) | (F.col("cross_rsi85") != 0),
    )


@register("SmaCross")
def sma_cross() -> Signal:
    return _cross_rule("cross_sma")


@register("TwelveMonthMomentum")
def twelve_month_momentum() -> Signal:
    return Signal(
        ("close_252",), above(close(), F.col("close_252")), at_most(close(), F.col("close_252"))
    )


@register("VwapReversion")
def vwap_reversion() -> Signal:
    return Signal(
        ("vwap", "std30"),
        below(close(), F.col("vwap") - 1.5 * F.col("std30")),
        above(close(), F.col("vwap")),
    )


def resolve(requested: str | Iterable[str] | None) -> list[str]:
    """Rule names of a run: nothing, ``all`` or ``*`` mean every rule; each name once."""
    if not requested or requested in ("all", "*"):
        return list(RULES)
    names = [requested] if isinstance(requested, str) else list(requested)
    if not all(isinstance(n, str) for n in names):
        raise TypeError("rule names must be strings")
    unknown = [n for n in names if n not in RULES]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    return list(dict.fromkeys(names))


def signal_flags(name: str) -> tuple[Column, Column]:
    """Entry and exit of one rule, false wherever one of its inputs is unknown."""
    signal = RULES[name]()
    ready = F.lit(True)
    for column in signal.needs:
        ready = ready & F.col(column).isNotNull()
    return (
        F.coalesce(ready & signal.entry, F.lit(False)),
        F.coalesce(ready & signal.exit, F.lit(False)),
    )


def stack_rules(df: DataFrame, names: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """One row per bar and rule: ``keep`` columns, strategy, entry, exit.

    The bars stay clustered by symbol, so windows per (symbol, strategy) need
    no further shuffle.  The signals are paired with their names by
    ``zip_with``, which Spark evaluates in a projection of its own: in one
    generated method with the generator and the sort behind it, all rules are
    too long for the JVM to compile, and each row of each rule is interpreted.
    """
    names, keep = list(names), list(keep)
    flags = [F.struct(e.alias("entry"), x.alias("exit")) for e, x in map(signal_flags, names)]

    def named(name: Column, flag: Column) -> Column:
        return F.struct(name.alias("strategy"), flag["entry"].alias("entry"), flag["exit"].alias("exit"))

    signals = F.zip_with(F.array(*map(F.lit, names)), F.array(*flags), named)
    return df.select(*keep, signals.alias("_signals")).select(*keep, F.inline("_signals"))


def tags_of(names: Iterable) -> list[str]:
    """Ends of the columns of each rule where rules stand beside each other."""
    return [f"_{i}" for i, _ in enumerate(names)]


def flags_beside(df: DataFrame, names: Iterable[str], keep: Iterable[str]) -> DataFrame:
    """One row per bar: ``keep`` columns, and entry and exit of every rule beside each other."""
    names = list(names)
    flags = [c.alias(f"{what}{t}") for t, n in zip(tags_of(names), names, strict=True) for what, c in zip(("entry", "exit"), signal_flags(n), strict=True)]
    return df.select(*[apart(c) if c == "bar_no" else c for c in keep], *flags)


def series_as_rows(df: DataFrame, columns: Iterable[str], labels: dict[str, Sequence]) -> DataFrame:
    """One row per bar and series of orders from rows that have ``columns`` of the series beside each other.

    ``labels`` are columns that tell the series apart, with a value for each.
    The generator's list is a constant, so nothing of the series is worked out
    once more to see whether it is empty, and columns nobody reads are pruned.
    """
    told = list(zip(*labels.values(), strict=True))
    tags = tags_of(told)
    per_series = [c for c in columns if f"{c}{tags[0]}" in df.columns]
    shared = [c for c in df.columns if c not in {f"{c}{t}" for c in per_series for t in tags}]
    lists = [F.array(*[F.col(f"{c}{t}") for t in tags]).alias(c) for c in per_series]
    places = F.array(*[F.struct(F.lit(i).alias("_place"), *[F.lit(v).alias(n) for n, v in zip(labels, row, strict=True)]) for i, row in enumerate(told)])
    rows = df.select(*[apart(c) if c == "bar_no" else c for c in shared], *lists).select("*", F.inline(places))
    return rows.select(*shared, *labels, *[F.get(F.col(c), F.col("_place")).alias(c) for c in per_series])
