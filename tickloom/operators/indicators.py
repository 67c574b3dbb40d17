"""Technical indicators as window columns over laid-out bars.

Builders that need only frames return a Column.  Builders that need recursive
smoothing or an unbounded scan take and return a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.compare import safe_divide, side
from tickloom.operators.smoothing import exponential, smooth, wilder
from tickloom.plans.layout import Layout, carry_in, own_rows, settled


def _from_bar(n: int, value: Column) -> Column:
    return F.when(F.col("bar_no") >= n, value)


def _rows(lay: Layout, n: int) -> WindowSpec:
    """Frame of the last ``n`` bars."""
    lay.reach(f"a frame of {n} bars", n - 1)
    return lay.rows(n - 1)


# ---- frames -----------------------------------------------------------------


def sma(lay: Layout, n: int, source: str = "close") -> Column:
    return _from_bar(n, F.avg(source).over(_rows(lay, n)))


def rolling_std(lay: Layout, n: int, source: str = "close") -> Column:
    """Population deviation of the last ``n`` values."""
    return _from_bar(n, F.stddev_pop(source).over(_rows(lay, n)))


def rolling_sum(lay: Layout, n: int, source: str) -> Column:
    return _from_bar(n, F.sum(source).over(_rows(lay, n)))


def highest(lay: Layout, n: int, source: str = "high") -> Column:
    return _from_bar(n, F.max(source).over(_rows(lay, n)))


def lowest(lay: Layout, n: int, source: str = "low") -> Column:
    return _from_bar(n, F.min(source).over(_rows(lay, n)))


def with_smas(df: DataFrame, lay: Layout, *periods: int, source: str = "close") -> DataFrame:
    """Several means at once (``sma<n>``).

    A frame of 200 bars would visit 200 rows per bar.  Sums of a short frame
    are added up at fixed distances instead, all read in one pass.
    """
    lay.reach(f"a mean of {max(periods)} bars", max(periods) - 1)
    common, goal = math.gcd(*periods), 1.5 * math.sqrt(max(periods))
    part = max(d for d in range(1, common + 1) if common % d == 0 and d <= goal)
    df = df.withColumn("_part", F.sum(source).over(lay.rows(part - 1)))
    return df.withColumns({
        f"sma{n}": _from_bar(n, reduce(Column.__add__, [_back("_part", k, lay) for k in range(0, n, part)]) / n)
        for n in periods
    }).drop("_part")


def with_extremes(df: DataFrame, lay: Layout, *periods: int) -> DataFrame:
    """Rolling highs and lows at once (``hh<n>``, ``ll<n>``), from overlapping short frames."""
    lay.reach(f"a range of {max(periods)} bars", max(periods) - 1)
    part = min(min(periods), math.isqrt(max(periods)))
    df = df.withColumns({
        "_h": F.max("high").over(lay.rows(part - 1)), "_l": F.min("low").over(lay.rows(part - 1)),
    })

    def over(column: str, n: int, pick: Callable[..., Column]) -> Column:
        backs = sorted({*range(0, n - part, part), n - part})
        parts = [_back(column, k, lay) for k in backs]
        return _from_bar(n, pick(*parts) if len(parts) > 1 else parts[0])

    return df.withColumns({
        **{f"hh{n}": over("_h", n, F.greatest) for n in periods},
        **{f"ll{n}": over("_l", n, F.least) for n in periods},
    }).drop("_h", "_l")


def _back(column: str, k: int, lay: Layout) -> Column:
    return F.lag(column, k).over(lay.window()) if k else F.col(column)


def bollinger(lay: Layout, n: int = 20, deviations: float = 2.0) -> dict[str, Column]:
    mid, spread = sma(lay, n), deviations * rolling_std(lay, n)
    return {"bb_mid": mid, "bb_top": mid + spread, "bb_bottom": mid - spread}


def ma_envelope(lay: Layout, n: int = 50, share: float = 0.02) -> dict[str, Column]:
    mid = sma(lay, n)
    return {"env_mid": mid, "env_upper": mid * (1 + share), "env_lower": mid * (1 - share)}


def bars_back(lay: Layout, k: int, source: str = "close") -> Column:
    lay.reach(f"the value {k} bars back", k)
    return F.lag(source, k).over(lay.window())


def momentum(lay: Layout, k: int) -> Column:
    return F.try_divide(F.col("close"), bars_back(lay, k)) - 1


def with_stochastic(df: DataFrame, lay: Layout, n: int = 14, slow: int = 3) -> DataFrame:
    """Slow %K in ``sto_k`` from ``hh<n>`` and ``ll<n>``; NULL while any of its ranges is empty."""
    low = F.col(f"ll{n}")
    df = df.withColumn("_fast_k", safe_divide(100 * (F.col("close") - low), F.col(f"hh{n}") - low))
    frame = lay.rows(slow - 1)
    full = F.count("_fast_k").over(frame) == slow
    return df.withColumn("sto_k", F.when(full, F.avg("_fast_k").over(frame))).drop("_fast_k")


def month_change(lay: Layout) -> Column:
    """True on the first bar of a month other than the previous bar's."""
    return F.coalesce(F.month("ts") != F.lag(F.month("ts")).over(lay.window()), F.lit(True))


# ---- running totals ---------------------------------------------------------


def with_running_sums(df: DataFrame, lay: Layout, sums: dict[str, Column]) -> DataFrame:
    """Totals from the first bar of the symbol on."""
    if not lay.chunked:
        return df.withColumns({n: F.sum(c).over(lay.so_far()) for n, c in sums.items()})
    own = F.col("own")
    df = settled(df, lay)
    df = df.withColumns({n: F.sum(F.when(own, c)).over(lay.so_far()) for n, c in sums.items()})
    df = carry_in(
        df,
        lay,
        {f"_{n}_total": F.sum(c) for n, c in sums.items()},
        lambda chunks, order: chunks.select(
            *lay.keys, "chunk", *[F.sum(f"_{n}_total").over(order.before()).alias(f"_{n}_in") for n in sums]
        ),
    )
    return df.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"_{n}_in"), F.lit(0)) for n in sums}
    ).drop(*[f"_{n}_in" for n in sums])


def with_vwap(df: DataFrame, lay: Layout, name: str = "vwap") -> DataFrame:
    """Volume-weighted mean price from the first bar; the close while nothing was traded."""
    df = with_running_sums(
        df, lay, {"_pv": F.col("close") * F.col("volume"), "_vol": F.col("volume")}
    )
    return df.withColumn(name, safe_divide(F.col("_pv"), F.col("_vol"), F.col("close"))).drop("_pv", "_vol")


def vwap_rolling(lay: Layout, n: int) -> Column:
    frame = _rows(lay, n)
    traded = F.sum("volume").over(frame)
    value = F.sum(F.col("close") * F.col("volume")).over(frame)
    return _from_bar(n, safe_divide(value, traded, F.col("close")))


# ---- crosses ----------------------------------------------------------------


def with_crosses(df: DataFrame, lay: Layout, differences: dict[str, Column], keep: Iterable[str] | None = None) -> DataFrame:
    """+1 when a difference turns positive, -1 when it turns negative, else 0.

    The previous side is the last one that was not zero, however far back.
    Where ``keep`` is given, other columns and the copies of a halo are not
    needed behind this, so chunks do not write them.
    """
    df = df.withColumns({f"_{n}_side": side(d) for n, d in differences.items()})
    counts = F.col("own") if lay.chunked else F.lit(True)   # halo rows may lack their own look-back
    taken = {n: F.when(counts & (F.col(f"_{n}_side") != 0), F.col(f"_{n}_side")) for n in differences}
    df = df.withColumns(
        {f"_{n}_prev": F.last(c, ignorenulls=True).over(lay.before()) for n, c in taken.items()}
    )
    previous = {n: F.col(f"_{n}_prev") for n in differences}
    if lay.chunked:
        if keep is not None:
            df = own_rows(df, lay).select(*keep, *[f"_{n}_{part}" for n in differences for part in ("side", "prev")])
        df = carry_in(
            settled(df, lay),
            lay,
            {f"_{n}_end": F.max_by(c, F.when(c.isNotNull(), F.col("bar_no"))) for n, c in taken.items()},
            lambda chunks, order: chunks.select(
                *lay.keys, "chunk",
                *[F.last(f"_{n}_end", ignorenulls=True).over(order.before()).alias(f"_{n}_in") for n in differences],
            ),
        )
        previous = {n: F.coalesce(c, F.col(f"_{n}_in")) for n, c in previous.items()}
    crosses = {}
    for n, before in previous.items():
        now = F.col(f"_{n}_side")
        crosses[n] = F.when(now.isNotNull(), F.when((now != 0) & (now == -before), now).otherwise(0))
    helpers = [f"_{n}_{part}" for n in differences for part in ("side", "prev", "in")]
    return df.withColumns(crosses).drop(*helpers)


def cross_down(cross: str) -> Column:
    return F.when(F.col(cross).isNotNull(), F.when(F.col(cross) == -1, 1).otherwise(0))


# ---- indicators built on recursive smoothing --------------------------------


def with_moves(df: DataFrame, lay: Layout) -> DataFrame:
    """Bar-to-bar moves that RSI, ATR and ADX smooth; NULL on the first bar."""
    df = df.withColumns(
        {f"_p{c[0]}": F.lag(c).over(lay.window()) for c in ("close", "high", "low")}
    )
    change = F.col("close") - F.col("_pc")
    rise, fall = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    seen = F.col("_pc").isNotNull()
    return df.withColumns({
        "up_move": F.when(seen, F.greatest(change, F.lit(0.0))),
        "down_move": F.when(seen, F.greatest(-change, F.lit(0.0))),
        "true_range": F.when(
            seen, F.greatest("high", "_pc") - F.least("low", "_pc")
        ),
        "plus_dm": F.when(seen, F.when((rise > fall) & (rise > 0), rise).otherwise(0.0)),
        "minus_dm": F.when(seen, F.when((fall > rise) & (fall > 0), fall).otherwise(0.0)),
    }).drop("_pc", "_ph", "_pl")


def rsi_value(up: Column, down: Column) -> Column:
    """100 - 100 / (1 + up / down); without down moves 100, without any move 50."""
    return (
        F.when(down != 0, 100 - 100 / (1 + up / down))
        .when(up > 0, 100.0)
        .when(up.isNotNull(), 50.0)
    )


def with_rsi(df: DataFrame, lay: Layout, n: int = 2) -> DataFrame:
    df = smooth(with_moves(df, lay), lay, {
        "_up": wilder(F.col("up_move"), n, first=2),
        "_down": wilder(F.col("down_move"), n, first=2),
    })
    return df.withColumn(f"rsi{n}", rsi_value(F.col("_up"), F.col("_down"))).drop("_up", "_down")


def with_ema(df: DataFrame, lay: Layout, *periods: int, source: str = "close") -> DataFrame:
    return smooth(df, lay, {f"ema{n}": exponential(F.col(source), n) for n in periods})


def with_atr(df: DataFrame, lay: Layout, *periods: int) -> DataFrame:
    return smooth(
        with_moves(df, lay), lay,
        {f"atr{n}": wilder(F.col("true_range"), n, first=2) for n in periods},
    )


def with_macd(df: DataFrame, lay: Layout, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = with_ema(df, lay, fast, slow)
    df = df.withColumn("macd", F.col(f"ema{fast}") - F.col(f"ema{slow}"))
    return smooth(df, lay, {"macd_signal": exponential(F.col("macd"), signal, first=slow)}, exponential(None, slow).reach)


def directional_index(n: int) -> Column:
    plus = safe_divide(100 * F.col(f"_pdm{n}"), F.col(f"atr{n}"), 0.0)
    minus = safe_divide(100 * F.col(f"_mdm{n}"), F.col(f"atr{n}"), 0.0)
    return safe_divide(100 * F.abs(plus - minus), plus + minus, 0.0)


def with_adx(df: DataFrame, lay: Layout, n: int = 14) -> DataFrame:
    df = smooth(with_moves(df, lay), lay, {
        f"atr{n}": wilder(F.col("true_range"), n, first=2),
        f"_pdm{n}": wilder(F.col("plus_dm"), n, first=2),
        f"_mdm{n}": wilder(F.col("minus_dm"), n, first=2),
    })
    df = df.withColumn("_dx", directional_index(n))
    return smooth(df, lay, {f"adx{n}": wilder(F.col("_dx"), n, first=n + 1)}, wilder(None, n, first=2).reach).drop(
        "_dx", f"_pdm{n}", f"_mdm{n}"
    )


# ---- everything the rule catalogue reads ------------------------------------

# What each column is computed from; columns not listed need bars only.
DEPENDS = {
    "tenkan": ("hh9", "ll9"),
    "kijun": ("hh26", "ll26"),
    "span_a": ("hh9", "ll9", "hh26", "ll26"),
    "span_b": ("hh52", "ll52"),
    "channel_high": ("hh20",),
    "channel_low": ("ll20",),
    "high20": ("hh20",),
    "sto_k": ("hh14", "ll14"),
    "rsi2": ("_up", "_down"),
    "macd": ("ema12", "ema26"),
    "macd_signal": ("macd",),
    "adx14": ("atr14", "_pdm14", "_mdm14"),
    "cross_sma": ("sma50", "sma200"),
    "cross_ema": ("ema12", "ema26"),
    "cross_macd": ("macd", "macd_signal"),
    "cross_tenkan": ("tenkan", "kijun"),
    "cross_rsi10": ("rsi2",),
    "cross_rsi15": ("rsi2",),
    "cross_rsi70": ("rsi2",),
    "cross_rsi85": ("rsi2",),
}


def _closure(columns: Iterable[str]) -> set[str]:
    found: set[str] = set()
    todo = list(columns)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo.extend(DEPENDS.get(name, ()))
    return found


def with_rule_indicators(df: DataFrame, lay: Layout, columns: Iterable[str], alone: bool = False) -> DataFrame:
    """The catalogue columns named in ``columns`` and what they rest on.

    Three groups: plain frames (one sort by time), smoothings (one sort by
    block) and crosses (same sort as the smoothings).  With ``alone``, what
    follows reads ``columns`` row by row: chunks write no halo and no helpers
    of theirs behind the smoothings.
    """
    columns = list(columns)
    keep = [*df.columns, *[c for c in columns if not c.startswith("cross_")]] if alone else None
    want = _closure(columns)
    if "vwap" in want:      # first, as chunks write what they have by then
        df = with_vwap(df, lay)

    def wanted(builders: dict[str, Callable[[], Column]]) -> dict[str, Column]:
        return {name: build() for name, build in builders.items() if name in want}

    def periods(prefix: str) -> list[int]:
        return sorted(int(c[len(prefix):]) for c in want if c.startswith(prefix) and c[len(prefix):].isdigit())

    if periods("sma"):
        df = with_smas(df, lay, *periods("sma"))
    if ranges := sorted({*periods("hh"), *periods("ll")}):
        df = with_extremes(df, lay, *ranges)

    def middle(n: int, shift: int = 0) -> Column:
        return (_back(f"hh{n}", shift, lay) + _back(f"ll{n}", shift, lay)) / 2

    df = df.withColumns(wanted({
        "std20": lambda: rolling_std(lay, 20),
        "std30": lambda: rolling_std(lay, 30),
        "high20": lambda: F.col("hh20"),
        "channel_high": lambda: _back("hh20", 1, lay),
        "channel_low": lambda: _back("ll20", 1, lay),
        "tenkan": lambda: middle(9),
        "kijun": lambda: middle(26),
        "span_a": lambda: (middle(9, 26) + middle(26, 26)) / 2,
        "span_b": lambda: middle(52, 26),
        "close_126": lambda: bars_back(lay, 126),
        "close_252": lambda: bars_back(lay, 252),
        "new_month": lambda: month_change(lay),
    }))
    if "sto_k" in want:
        df = with_stochastic(df, lay, 14)

    moves = {"_up": "up_move", "_down": "down_move", "_pdm14": "plus_dm", "_mdm14": "minus_dm"}
    first = {f"ema{n}": exponential(F.col("close"), n) for n in periods("ema")}
    first |= {f"atr{n}": wilder(F.col("true_range"), n, first=2) for n in periods("atr")}
    first |= {c: wilder(F.col(m), 14 if c.endswith("14") else 2, first=2) for c, m in moves.items() if c in want}
    if first:
        df = smooth(with_moves(df, lay), lay, first)
    df = df.withColumns(wanted({
        "rsi2": lambda: rsi_value(F.col("_up"), F.col("_down")),
        "macd": lambda: F.col("ema12") - F.col("ema26"),
    }))
    second = {}
    if "macd_signal" in want:
        second["macd_signal"] = exponential(F.col("macd"), 9, first=26)
    if "adx14" in want:
        df = df.withColumn("_dx", directional_index(14))
        second["adx14"] = wilder(F.col("_dx"), 14, first=15)
    if second:
        df = smooth(df, lay, second, max(s.reach for s in first.values()))

    crosses = wanted({
        "cross_sma": lambda: F.col("sma50") - F.col("sma200"),
        "cross_ema": lambda: F.col("ema12") - F.col("ema26"),
        "cross_macd": lambda: F.col("macd") - F.col("macd_signal"),
        "cross_tenkan": lambda: F.col("tenkan") - F.col("kijun"),
        "cross_rsi10": lambda: F.col("rsi2") - 10,
        "cross_rsi15": lambda: F.col("rsi2") - 15,
        "cross_rsi70": lambda: F.col("rsi2") - 70,
        "cross_rsi85": lambda: F.col("rsi2") - 85,
    })
    if crosses:
        df = with_crosses(df, lay.by_block() if first else lay, crosses, keep)
    return df
