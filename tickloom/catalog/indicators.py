"""Indicators and rules, one query each, over every bar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import sql as S
from tickloom.catalog.registry import day, laid, laid_in_chunks, query, rounded, rounded_sql
from tickloom.functions.compare import if_else, safe_divide
from tickloom.operators import indicators as ind
from tickloom.operators.custom import custom_indicator
from tickloom.operators.rules import RULES
from tickloom.operators.smoothing import exponential, smooth, wilder
from tickloom.plans.backtest import signals
from tickloom.plans.layout import Layout, own_rows

Build = Callable[[DataFrame, Layout], DataFrame]


def _indicator(name: str, columns: list[str], build: Build, check: str, exact: bool = False, back: int | None = None, reach: int | None = None) -> None:
    """``check`` is the FROM part: CTEs and the last CTE's name as ``... @ name``.

    With ``back`` the bars are laid out in small chunks with a halo of that many bars; with ``reach`` the
    halo is that long where the sizes ask for chunks.
    """
    ctes, source = check.rsplit("@", 1)
    picked = ", ".join(columns) if exact else rounded_sql(*columns)

    @query(name, f"WITH RECURSIVE {ctes} SELECT symbol, day, {picked} FROM {source}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df, lay = laid(spark, folder, reach) if back is None else laid_in_chunks(spark, folder, back)
        values = [F.col(c) for c in columns] if exact else rounded(*columns)
        return own_rows(build(df, lay), lay).select("symbol", day(), *values)


def _columns(build: Callable[[Layout], dict[str, Column]]) -> Build:
    return lambda df, lay: df.withColumns(build(lay))


def _catalogue(*columns: str) -> Build:
    return lambda df, lay: ind.with_rule_indicators(df, lay, columns)


def _selected(**expressions: str) -> str:
    picked = ", ".join(f"{e} AS {n}" for n, e in expressions.items())
    return f"{S.BARS}, picked AS (SELECT symbol, day, {picked} FROM bars) @ picked"


def _plain(*names: str, more: str = "") -> str:
    return f"{S.BARS}, {S.plain(*names)}, picked AS (SELECT *{more} FROM ind) @ picked"


def _recursive(*names: str, more: str = "", plain: tuple[str, ...] = ()) -> str:
    return f"{S.BARS}, {S.smoothed(*names, plain_columns=plain)}, picked AS (SELECT *{more} FROM rec) @ picked"


def _smoothed(wanted: dict[str, tuple], moves: bool = False) -> str:
    source = f"{S.plain()}, {S.MOVES}" if moves else S.plain()
    return f"{S.BARS}, {source}, {S.smooth('moves' if moves else 'ind', 'rec', wanted)} @ rec"


_indicator("sma", ["sma20", "sma50", "sma200"], lambda df, lay: ind.with_smas(df, lay, 20, 50, 200),
           _selected(sma20=S.sma(20), sma50=S.sma(50), sma200=S.sma(200)))
_indicator("ema", ["ema12", "ema20", "ema26"], lambda df, lay: ind.with_ema(df, lay, 12, 20, 26),
           _smoothed({f"ema{n}": S.ema(n) for n in (12, 20, 26)}))
_indicator(
    "recursive_smooth", ["slow", "quick"],
    lambda df, lay: smooth(df, lay, {"slow": exponential(F.col("volume"), 5), "quick": wilder(F.col("high"), 3)}),
    _smoothed({"slow": S.ema(5, "volume"), "quick": ("high", 1 - 1 / 3, 3, 1)}),
)
_indicator(
    "wilder_smooth", ["w2", "w14", "w20", "w30"],
    lambda df, lay: smooth(df, lay, {f"w{n}": wilder(F.col("close"), n) for n in (2, 14, 20, 30)}),
    _smoothed({f"w{n}": S.wilder("close", n, 1) for n in (2, 14, 20, 30)}),
)
_indicator("short_long_ema", ["ema2", "ema300"], lambda df, lay: ind.with_ema(df, lay, 2, 300),
           _smoothed({f"ema{n}": S.ema(n) for n in (2, 300)}), reach=exponential(None, 300).reach)

# the layout of keys too large for one task, with halos just as long as what is read
_indicator("chunked_sma", ["sma20", "sma50", "sma200"], lambda df, lay: ind.with_smas(df, lay, 20, 50, 200),
           _selected(sma20=S.sma(20), sma50=S.sma(50), sma200=S.sma(200)), back=199)
_indicator("chunked_ema", ["ema2", "ema300"], lambda df, lay: ind.with_ema(df, lay, 2, 300),
           _smoothed({f"ema{n}": S.ema(n) for n in (2, 300)}), back=exponential(None, 300).reach)
_indicator("chunked_macd", ["macd", "macd_signal"], ind.with_macd, _recursive("macd", "macd_signal"),
           back=exponential(None, 26).reach + exponential(None, 9, first=26).reach)
_indicator("chunked_adx", ["adx14"], ind.with_adx, _recursive("adx14"),
           back=wilder(None, 14, first=2).reach + wilder(None, 14, first=15).reach)
_indicator("rolling_std", ["std30"], _columns(lambda lay: {"std30": ind.rolling_std(lay, 30)}), _selected(std30=S.std(30)))
_indicator("bollinger", ["bb_top", "bb_mid", "bb_bottom"], _columns(ind.bollinger), _selected(
    bb_mid=S.sma(20), bb_top=f"{S.sma(20)} + 2 * {S.std(20)}", bb_bottom=f"{S.sma(20)} - 2 * {S.std(20)}"))
_indicator("rsi", ["rsi2"], ind.with_rsi, _recursive("rsi2"))
_indicator("macd", ["macd", "macd_signal"], ind.with_macd, _recursive("macd", "macd_signal"))
_indicator("highest", ["highest20"], _columns(lambda lay: {"highest20": ind.highest(lay, 20)}),
           _selected(highest20=S.high(20)), exact=True)
_indicator("lowest", ["lowest20"], _columns(lambda lay: {"lowest20": ind.lowest(lay, 20)}),
           _selected(lowest20=S.low(20)), exact=True)
_indicator("donchian_prev", ["channel_high", "channel_low"], _catalogue("channel_high", "channel_low"),
           _plain("channel_high", "channel_low"), exact=True)
_indicator("atr", ["true_range", "atr20", "atr30"], lambda df, lay: ind.with_atr(df, lay, 20, 30), _recursive("atr20", "atr30"))
_indicator("adx", ["adx14"], ind.with_adx, _recursive("adx14"))
_indicator("ma_envelope", ["env_upper", "env_lower"], _columns(ind.ma_envelope),
           _selected(env_upper=f"{S.sma(50)} * 1.02", env_lower=f"{S.sma(50)} * 0.98"))
_indicator(
    "keltner", ["ema20", "keltner_upper"],
    lambda df, lay: _catalogue("ema20", "atr20")(df, lay).withColumn("keltner_upper", F.col("ema20") + 1.5 * F.col("atr20")),
    _recursive("ema20", "atr20", more=", ema20 + 1.5 * atr20 AS keltner_upper"),
)
_indicator(
    "atr_stop", ["stop"],
    lambda df, lay: _catalogue("high20", "atr20")(df, lay).withColumn("stop", F.col("high20") - 3.0 * F.col("atr20")),
    _recursive("atr20", plain=("high20",), more=", high20 - 3.0 * atr20 AS stop"),
)
_CLOUD = ("tenkan", "kijun", "span_a", "span_b")
_indicator("ichimoku", list(_CLOUD), _catalogue(*_CLOUD), _plain(*_CLOUD))
_indicator("stochastic_k", ["sto_k"], _catalogue("sto_k"), _plain("sto_k"))
_indicator(
    "cumulative_sum", ["total_volume"],
    lambda df, lay: ind.with_running_sums(df, lay, {"total_volume": F.col("volume")}),
    _selected(total_volume=f"CAST(SUM(volume) OVER {S.CUM} AS BIGINT)"), exact=True,
)
_indicator("rolling_sum", ["volume10"], _columns(lambda lay: {"volume10": ind.rolling_sum(lay, 10, "volume")}),
           _selected(volume10=S.from_bar(10, f"CAST(SUM(volume) OVER {S.rows(9)} AS BIGINT)")), exact=True)
_indicator("vwap_cumulative", ["vwap"], ind.with_vwap, _plain("vwap"))
_indicator(
    "vwap_rolling", ["vwap20"], _columns(lambda lay: {"vwap20": ind.vwap_rolling(lay, 20)}),
    _selected(vwap20=S.from_bar(20, f"SUM(close * volume) OVER {S.rows(19)} / NULLIF(SUM(volume) OVER {S.rows(19)}, 0)")),
)
_indicator(
    "safe_divide", ["ratio"],
    _columns(lambda lay: {"ratio": safe_divide(F.col("high") - F.col("low"), F.col("close") - F.col("open"), 0.0)}),
    _selected(ratio="CASE WHEN close - open = 0 THEN 0 ELSE (high - low) / (close - open) END"),
)
_indicator(
    "if_else", ["shown"],
    _columns(lambda lay: {"shown": if_else(F.col("volume") % 10 == 0, F.col("close"), F.col("open"))}),
    _selected(shown="CASE WHEN volume % 10 = 0 THEN close ELSE open END"), exact=True,
)
_indicator(
    "vwap_std_band", ["band_upper", "band_lower"],
    lambda df, lay: _catalogue("vwap", "std30")(df, lay).withColumns({
        "band_upper": F.col("vwap") + 1.5 * F.col("std30"), "band_lower": F.col("vwap") - 1.5 * F.col("std30")}),
    _plain("vwap", "std30", more=", vwap + 1.5 * std30 AS band_upper, vwap - 1.5 * std30 AS band_lower"),
)
_indicator(
    "vwap_atr_band", ["band_upper", "band_lower"],
    lambda df, lay: _catalogue("vwap", "atr30")(df, lay).withColumns({
        "band_upper": F.col("vwap") + 1.8 * F.col("atr30"), "band_lower": F.col("vwap") - 1.8 * F.col("atr30")}),
    _recursive("atr30", plain=("vwap",), more=", vwap + 1.8 * atr30 AS band_upper, vwap - 1.8 * atr30 AS band_lower"),
)
_indicator(
    "momentum", ["mom252", "mom126"],
    _columns(lambda lay: {"mom252": ind.momentum(lay, 252), "mom126": ind.momentum(lay, 126)}),
    _selected(mom252=f"close / {S.lag('close', 252)} - 1", mom126=f"close / {S.lag('close', 126)} - 1"),
)
_CROSSES = {"sma_pair": "sma20 - sma50", "level": "close - 100.0e0"}


def _crosses(df: DataFrame, lay: Layout) -> DataFrame:
    return ind.with_crosses(ind.with_smas(df, lay, 20, 50), lay, {n: F.expr(d) for n, d in _CROSSES.items()})


_CROSS_SQL = f"{S.BARS}, {S.plain('sma20', 'sma50')}, {S.crosses('ind', 'crossed', _CROSSES)}"
_indicator("cross_signal", list(_CROSSES), _crosses, f"{_CROSS_SQL} @ crossed", exact=True)
_indicator(
    "cross_down", ["fell"], lambda df, lay: _crosses(df, lay).withColumn("fell", ind.cross_down("level")),
    f"{_CROSS_SQL}, picked AS (SELECT *, CASE WHEN level IS NOT NULL THEN CAST(level = -1 AS INT) END AS fell FROM crossed) @ picked",
    exact=True,
)
_indicator("month_change", ["new_month"], _columns(lambda lay: {"new_month": ind.month_change(lay)}),
           _plain("new_month"), exact=True)
_indicator("bar_number", ["bar_no"], lambda df, lay: df, f"{S.BARS} @ bars", exact=True)
_indicator("lag_access", ["close_1", "close_5"],
           _columns(lambda lay: {"close_1": ind.bars_back(lay, 1), "close_5": ind.bars_back(lay, 5)}),
           _selected(close_1=S.lag("close", 1), close_5=S.lag("close", 5)), exact=True)
_indicator("moving_average_overlay", ["sma12", "sma26"], lambda df, lay: ind.with_smas(df, lay, 12, 26),
           _selected(sma12=S.sma(12), sma26=S.sma(26)))
_indicator(
    "custom_indicator", ["median5"],
    lambda df, lay: custom_indicator(df, lay, "median5", 4, lambda bars: bars["close"].rolling(5).median()),
    _selected(median5=S.from_bar(5, f"MEDIAN(close) OVER {S.rows(4)}")),
)

# Query names of the rules, next to their public names.
RULE_QUERIES = {
    "golden_cross": "GoldenCross",
    "buy_and_hold": "BuyAndHold",
    "sma_cross": "SmaCross",
    "ema_cross": "EmaCross",
    "rsi2": "Rsi2",
    "bollinger_breakout": "BollingerBreakout",
    "macd_signal": "MacdSignal",
    "donchian_turtle": "DonchianTurtle",
    "ma_envelope_rule": "MaEnvelope",
    "twelve_month_momentum": "TwelveMonthMomentum",
    "vwap_reversion": "VwapReversion",
    "atr_trailing_trend": "AtrTrailingTrend",
    "keltner_breakout": "KeltnerBreakout",
    "ichimoku_trend": "IchimokuTrend",
    "rsi_stoch_combo": "RsiStochCombo",
    "monthly_rotator": "MonthlyRotator",
    "adx_breakout": "AdxBreakout",
    "atr_channel_reversion": "AtrChannelReversion",
}
assert set(RULE_QUERIES.values()) == set(RULES)


def _rule(name: str, strategy: str) -> None:
    @query(name, f"""
WITH RECURSIVE {S.rule_flags(strategy)}
SELECT symbol, strategy, day, CAST(entry AS INT) AS entry, CAST(exit AS INT) AS exit FROM flags""")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df, lay = signals(*laid(spark, folder), strategy)
        return own_rows(df, lay).select(
            "symbol", "strategy", day(), F.col("entry").cast("int").alias("entry"), F.col("exit").cast("int").alias("exit")
        )


for _name, _strategy in RULE_QUERIES.items():
    _rule(_name, _strategy)
