"""Building blocks of the check SQL (DuckDB dialect).

The checks follow the published definitions by other means than the Spark
code: recursions run bar by bar, the account is simulated order by order.
"""

from __future__ import annotations

# ---- bars -------------------------------------------------------------------

BARS = """
days AS MATERIALIZED (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v,
         CAST(SUM(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2),
walk AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY day) AS bar_no,
         GREATEST(100, 10000 + CAST(SUM(v % 401 - 200) OVER (PARTITION BY symbol ORDER BY day) AS BIGINT)) AS c
  FROM days),
opened AS (
  SELECT *, GREATEST(100, COALESCE(LAG(c) OVER (PARTITION BY symbol ORDER BY day), 10000)
                          + (v // 7) % 101 - 50) AS o
  FROM walk),
bars AS MATERIALIZED (
  SELECT symbol, day, bar_no, o / 100.0e0 AS open, (GREATEST(o, c) + (v // 11) % 50) / 100.0e0 AS high,
         (LEAST(o, c) - (v // 13) % 50) / 100.0e0 AS low, c / 100.0e0 AS close, volume
  FROM opened)"""

W = "PARTITION BY symbol ORDER BY bar_no"
CUM = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rows(back: int, ahead: str = "CURRENT ROW") -> str:
    return f"({W} ROWS BETWEEN {back} PRECEDING AND {ahead})"


def from_bar(n: int, expression: str) -> str:
    return f"CASE WHEN bar_no >= {n} THEN {expression} END"


def sma(n: int, column: str = "close") -> str:
    return from_bar(n, f"AVG({column}) OVER {rows(n - 1)}")


def std(n: int, column: str = "close") -> str:
    return from_bar(n, f"STDDEV_POP({column}) OVER {rows(n - 1)}")


def high(n: int) -> str:
    return from_bar(n, f"MAX(high) OVER {rows(n - 1)}")


def low(n: int) -> str:
    return from_bar(n, f"MIN(low) OVER {rows(n - 1)}")


def lag(column: str, k: int = 1) -> str:
    return f"LAG({column}, {k}) OVER ({W})"


VWAP = f"COALESCE(SUM(close * volume) OVER {CUM} / NULLIF(SUM(volume) OVER {CUM}, 0), close)"

PLAIN = {
    "sma20": sma(20), "sma50": sma(50), "sma200": sma(200), "std20": std(20), "std30": std(30),
    "high20": high(20), "low20": low(20),
    "channel_high": from_bar(21, f"MAX(high) OVER {rows(20, '1 PRECEDING')}"),
    "channel_low": from_bar(21, f"MIN(low) OVER {rows(20, '1 PRECEDING')}"),
    "tenkan": f"({high(9)} + {low(9)}) / 2", "kijun": f"({high(26)} + {low(26)}) / 2",
    "middle52": f"({high(52)} + {low(52)}) / 2",
    "hh14": high(14), "ll14": low(14),
    "vwap": VWAP,
    "close_126": lag("close", 126), "close_252": lag("close", 252),
    "new_month": f"COALESCE(MONTH(day) <> MONTH({lag('day')}), TRUE)",
}


def plain(*names: str) -> str:
    """CTE ``ind``: bars with plain indicator columns, two steps deep where one rests on another."""
    first = set(names) - {"span_a", "span_b", "sto_k"}
    if "span_a" in names:
        first |= {"tenkan", "kijun"}
    if "span_b" in names:
        first |= {"middle52"}
    if "sto_k" in names:
        first |= {"hh14", "ll14"}
    one = ", ".join(f"{PLAIN[n]} AS {n}" for n in sorted(first))
    steps = [f"ind1 AS (SELECT *{', ' + one if one else ''} FROM bars)"]
    extra = []
    if "span_a" in names:
        extra.append(f"LAG((tenkan + kijun) / 2, 26) OVER ({W}) AS span_a")
    if "span_b" in names:
        extra.append(f"LAG(middle52, 26) OVER ({W}) AS span_b")
    if "sto_k" in names:
        extra.append("100 * (close - ll14) / NULLIF(hh14 - ll14, 0) AS fast_k")
    steps.append(f"ind2 AS (SELECT *{''.join(', ' + e for e in extra)} FROM ind1)")
    sto = (
        f", CASE WHEN COUNT(fast_k) OVER {rows(2)} = 3 THEN AVG(fast_k) OVER {rows(2)} END AS sto_k"
        if "sto_k" in names else ""
    )
    steps.append(f"ind AS MATERIALIZED (SELECT *{sto} FROM ind2)")
    return ",\n".join(steps)


# ---- recursive smoothing ----------------------------------------------------

MOVES = f"""
prevs AS (
  SELECT *, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl FROM ind),
moves AS MATERIALIZED (
  SELECT *, CASE WHEN pc IS NOT NULL THEN GREATEST(close - pc, 0) END AS up_move,
         CASE WHEN pc IS NOT NULL THEN GREATEST(pc - close, 0) END AS down_move,
         CASE WHEN pc IS NOT NULL THEN GREATEST(high, pc) - LEAST(low, pc) END AS true_range,
         CASE WHEN pc IS NULL THEN NULL WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS plus_dm,
         CASE WHEN pc IS NULL THEN NULL WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS minus_dm
  FROM prevs)"""


def smooth(source: str, target: str, wanted: dict[str, tuple[str, float, int, int]]) -> str:
    """CTE ``target``: ``source`` plus one recursive mean per entry (input, keep, period, first valid bar)."""
    seeds = ", ".join(
        f"AVG({x}) OVER {rows(n - 1)} AS seed_{name}" for name, (x, _, n, _) in wanted.items()
    )
    start = ", ".join(
        (f"CASE WHEN bar_no = {first + n - 1} THEN seed_{name} END AS {name}")
        for name, (_, _, n, first) in wanted.items()
    )
    step = ", ".join(
        f"CASE WHEN s.bar_no = {first + n - 1} THEN s.seed_{name} "
        f"WHEN s.bar_no > {first + n - 1} THEN {keep!r}::DOUBLE * r.{name} + {1 - keep!r}::DOUBLE * s.{x} END"
        for name, (x, keep, n, first) in wanted.items()
    )
    names = ", ".join(f"r.{name}" for name in wanted)
    return f"""
seeded_{target} AS MATERIALIZED (SELECT *, {seeds} FROM {source}),
rec_{target} AS (
  SELECT symbol, bar_no, {start} FROM seeded_{target} WHERE bar_no = 1
  UNION ALL
  SELECT s.symbol, s.bar_no, {step}
  FROM rec_{target} r JOIN seeded_{target} s ON s.symbol = r.symbol AND s.bar_no = r.bar_no + 1),
{target} AS MATERIALIZED (
  SELECT s.*, {names} FROM {source} s JOIN rec_{target} r ON r.symbol = s.symbol AND r.bar_no = s.bar_no)"""


def ema(n: int, column: str = "close", first: int = 1) -> tuple[str, float, int, int]:
    return column, 1 - 2 / (n + 1), n, first


def wilder(column: str, n: int, first: int = 2) -> tuple[str, float, int, int]:
    return column, 1 - 1 / n, n, first


RSI = "CASE WHEN down <> 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100.0 WHEN up IS NOT NULL THEN 50.0 END"
SMOOTHED = {
    "ema12": ema(12), "ema20": ema(20), "ema26": ema(26),
    "atr14": wilder("true_range", 14), "atr20": wilder("true_range", 20), "atr30": wilder("true_range", 30),
    "up": wilder("up_move", 2), "down": wilder("down_move", 2),
    "pdm": wilder("plus_dm", 14), "mdm": wilder("minus_dm", 14),
}
DX = """
CASE WHEN pdm + mdm = 0 OR atr14 = 0 THEN 0 ELSE
  100 * ABS(100 * pdm / atr14 - 100 * mdm / atr14) / (100 * pdm / atr14 + 100 * mdm / atr14) END"""


def smoothed(*names: str, plain_columns: tuple[str, ...] = ()) -> str:
    """CTE ``rec``: bars with the named recursive columns (rsi2, macd, macd_signal, adx14, ema.., atr..)."""
    need: set[str] = set(names) & set(SMOOTHED)
    if "rsi2" in names:
        need |= {"up", "down"}
    if {"macd", "macd_signal"} & set(names):
        need |= {"ema12", "ema26"}
    if "adx14" in names:
        need |= {"atr14", "pdm", "mdm"}
    parts = [plain(*plain_columns), MOVES, smooth("moves", "one", {n: SMOOTHED[n] for n in sorted(need)})]
    extra = []
    if "rsi2" in names:
        extra.append(f"{RSI} AS rsi2")
    if {"macd", "macd_signal"} & set(names):
        extra.append("ema12 - ema26 AS macd")
    if "adx14" in names:
        extra.append(f"CASE WHEN bar_no >= 15 THEN {DX} END AS dx")
    parts.append(f"two AS MATERIALIZED (SELECT *{''.join(', ' + e for e in extra)} FROM one)")
    again = {}
    if "macd_signal" in names:
        again["macd_signal"] = ema(9, "macd", 26)
    if "adx14" in names:
        again["adx14"] = wilder("dx", 14, 15)
    parts.append(smooth("two", "rec", again) if again else "rec AS (SELECT * FROM two)")
    return ",\n".join(parts)


# ---- crosses ----------------------------------------------------------------


def crosses(source: str, target: str, differences: dict[str, str]) -> str:
    sides = ", ".join(
        f"CASE WHEN {d} > 1e-9 THEN 1 WHEN {d} < -1e-9 THEN -1 WHEN {d} IS NOT NULL THEN 0 END AS side_{n}"
        for n, d in differences.items()
    )
    before = ", ".join(
        f"LAST_VALUE(CASE WHEN side_{n} <> 0 THEN side_{n} END IGNORE NULLS) OVER "
        f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_{n}"
        for n in differences
    )
    result = ", ".join(
        f"CASE WHEN side_{n} IS NULL THEN NULL WHEN side_{n} = 1 AND prev_{n} = -1 THEN 1 "
        f"WHEN side_{n} = -1 AND prev_{n} = 1 THEN -1 ELSE 0 END AS {n}"
        for n in differences
    )
    return f"""
sides_{target} AS (SELECT *, {sides} FROM {source}),
prev_{target} AS (SELECT *, {before} FROM sides_{target}),
{target} AS MATERIALIZED (SELECT *, {result} FROM prev_{target})"""


# ---- rules ------------------------------------------------------------------

DIFFERENCES = {
    "cross_sma": "sma50 - sma200", "cross_ema": "ema12 - ema26", "cross_macd": "macd - macd_signal",
    "cross_tenkan": "tenkan - kijun", "cross_rsi10": "rsi2 - 10", "cross_rsi15": "rsi2 - 15",
    "cross_rsi70": "rsi2 - 70", "cross_rsi85": "rsi2 - 85",
}

# rule: (plain columns, recursive columns, crosses, inputs that must be known, entry, exit)
RULES = {
    "AdxBreakout": (("channel_high", "channel_low"), ("adx14",), (), "channel_high, channel_low, adx14",
                    "close - channel_high > -1e-9 AND adx14 > 25 + 1e-9", "close - channel_low < 1e-9"),
    "AtrChannelReversion": (("vwap",), ("atr30",), (), "vwap, atr30",
                            "close - (vwap - 1.8 * atr30) < -1e-9", "close - vwap > -1e-9"),
    "AtrTrailingTrend": (("high20",), ("atr20",), (), "high20, atr20",
                         "close - (high20 - 3.0 * atr20) > 1e-9", "close - (high20 - 3.0 * atr20) < -1e-9"),
    "BollingerBreakout": (("sma20", "std20"), (), (), "sma20, std20",
                          "close - (sma20 + 2.0 * std20) > 1e-9", "close - sma20 < -1e-9"),
    "BuyAndHold": ((), (), (), "close", "TRUE", "FALSE"),
    "DonchianTurtle": (("channel_high", "channel_low"), (), (), "channel_high, channel_low",
                       "close >= channel_high", "close <= channel_low"),
    "EmaCross": ((), ("ema12", "ema26"), ("cross_ema",), "cross_ema", "cross_ema = 1", "cross_ema = -1"),
    "GoldenCross": (("sma50", "sma200"), (), ("cross_sma",), "cross_sma", "cross_sma = 1", "cross_sma = -1"),
    "IchimokuTrend": (("tenkan", "kijun", "span_a", "span_b"), (), ("cross_tenkan",), "span_a, span_b, cross_tenkan",
                      "close - GREATEST(span_a, span_b) > 1e-9 AND cross_tenkan = 1",
                      "cross_tenkan = -1 OR NOT close - GREATEST(span_a, span_b) > 1e-9"),
    "KeltnerBreakout": ((), ("ema20", "atr20"), (), "ema20, atr20",
                        "close - (ema20 + 1.5 * atr20) > 1e-9", "close - ema20 < -1e-9"),
    "MaEnvelope": (("sma50",), (), (), "sma50", "close - sma50 * 1.02 > 1e-9", "close - sma50 * 0.98 < -1e-9"),
    "MacdSignal": ((), ("macd", "macd_signal"), ("cross_macd",), "cross_macd", "cross_macd = 1", "cross_macd = -1"),
    "MonthlyRotator": (("close_126", "close_252", "new_month"), (), (), "close_252, close_126",
                       "new_month AND close > close_252 AND close > close_126",
                       "new_month AND (close <= close_252 OR close <= close_126)"),
    "Rsi2": (("sma200",), ("rsi2",), ("cross_rsi10", "cross_rsi70"), "sma200, cross_rsi10, cross_rsi70",
             "close - sma200 > 1e-9 AND cross_rsi10 = -1", "cross_rsi70 <> 0"),
    "RsiStochCombo": (("sto_k",), ("rsi2",), ("cross_rsi85", "cross_rsi15"), "rsi2, sto_k, cross_rsi85, cross_rsi15",
                      "rsi2 < 15 - 1e-9 AND sto_k < 15 - 1e-9", "rsi2 > 85 + 1e-9 OR cross_rsi85 <> 0"),
    "SmaCross": (("sma50", "sma200"), (), ("cross_sma",), "cross_sma", "cross_sma = 1", "cross_sma = -1"),
    "TwelveMonthMomentum": (("close_252",), (), (), "close_252", "close > close_252", "close <= close_252"),
    "VwapReversion": (("vwap", "std30"), (), (), "vwap, std30",
                      "close - (vwap - 1.5 * std30) < -1e-9", "close - vwap > 1e-9"),
}


def rule_flags(*names: str) -> str:
    """CTE ``flags``: symbol, strategy, bar columns, entry, exit for the named rules."""
    plain_columns, recursive, crossing = set(), set(), set()
    for n in names:
        p, r, x, *_ = RULES[n]
        plain_columns |= set(p)
        recursive |= set(r)
        crossing |= set(x)
    if recursive:
        parts = [BARS, smoothed(*sorted(recursive), plain_columns=tuple(sorted(plain_columns)))]
        source = "rec"
    else:
        parts = [BARS, plain(*sorted(plain_columns))]
        source = "ind"
    if crossing:
        parts.append(crosses(source, "crossed", {n: DIFFERENCES[n] for n in sorted(crossing)}))
        source = "crossed"
    selects = []
    for n in names:
        *_, inputs, entry, leave = RULES[n]
        known = " AND ".join(f"{c.strip()} IS NOT NULL" for c in inputs.split(","))
        selects.append(
            f"SELECT symbol, '{n}' AS strategy, day, bar_no, open, high, low, close,\n"
            f"  COALESCE({known} AND ({entry}), FALSE) AS entry, COALESCE({known} AND ({leave}), FALSE) AS exit FROM {source}"
        )
    union = "\nUNION ALL\n".join(selects)
    return ",\n".join(parts) + f",\nflags AS MATERIALIZED ({union})"


# ---- account ----------------------------------------------------------------


def account(source: str = "flags", keys: str = "symbol, strategy", capital: float = 1000.0,
            commission: str = "0.001", slippage: str = "0.0005") -> str:
    """CTE ``acct``: the account order by order, one recursion step per bar."""
    names = [k.strip() for k in keys.split(",")]
    fees = ", s.commission" if commission == "commission" else ""
    s_keys, same = ", ".join(f"s.{k}" for k in names), " AND ".join(f"s.{k} = r.{k}" for k in names)
    by = f"PARTITION BY {keys} ORDER BY bar_no"
    return f"""
orders AS MATERIALIZED (
  SELECT *, LAG(entry) OVER ({by}) AS p_entry, LAG(exit) OVER ({by}) AS p_exit, LAG(close) OVER ({by}) AS p_close,
         LEAST(high, open * (1 + {slippage})) AS buy, GREATEST(low, open * (1 - {slippage})) AS sell
  FROM {source}),
acct AS (
  SELECT {keys}, bar_no, day, close, 0 AS pos, 0 AS act, {capital!r}::DOUBLE AS cash, 0.0::DOUBLE AS size,
         {capital!r}::DOUBLE AS equity, NULL::DOUBLE AS entry_price, NULL::DATE AS entry_day, NULL::BIGINT AS entry_bar,
         NULL::DOUBLE AS exit_price, NULL::DOUBLE AS pnl_gross, NULL::DOUBLE AS pnl_net, 0.0::DOUBLE AS traded
  FROM orders WHERE bar_no = 1
  UNION ALL
  SELECT {keys}, bar_no, day, close, CASE WHEN act = 1 THEN 1 WHEN act = -1 THEN 0 ELSE pos END, act,
         CASE WHEN act = 1 THEN cash - new_size * buy * (1 + {commission})
              WHEN act = -1 THEN cash + size * sell * (1 - {commission}) ELSE cash END,
         CASE WHEN act = 1 THEN new_size WHEN act = -1 THEN 0 ELSE size END,
         CASE WHEN act = 1 THEN cash - new_size * buy * (1 + {commission}) + new_size * close
              WHEN act = -1 THEN cash + size * sell * (1 - {commission}) ELSE cash + size * close END,
         CASE WHEN act = 1 THEN buy ELSE entry_price END, CASE WHEN act = 1 THEN day ELSE entry_day END,
         CASE WHEN act = 1 THEN bar_no ELSE entry_bar END,
         CASE WHEN act = -1 THEN sell END,
         CASE WHEN act = -1 THEN size * (sell - entry_price) END,
         CASE WHEN act = -1 THEN size * (sell - entry_price) - size * {commission} * (sell + entry_price) END,
         CASE WHEN act = 1 THEN new_size * buy WHEN act = -1 THEN size * sell ELSE 0 END
  FROM (
    SELECT {s_keys}, s.bar_no, s.day, s.close, s.buy, s.sell{fees}, r.pos, r.cash, r.size, r.entry_price, r.entry_day, r.entry_bar,
           0.95 * r.cash / s.p_close AS new_size,
           CASE WHEN r.pos = 0 AND s.p_entry AND 0.95 * s.buy * (1 + {'s.' + commission if fees else commission}) / s.p_close <= 1 THEN 1
                WHEN r.pos = 1 AND s.p_exit THEN -1 ELSE 0 END AS act
    FROM acct r JOIN orders s ON {same} AND s.bar_no = r.bar_no + 1))"""


def returns(keys: str = "symbol, strategy", capital: float = 1000.0) -> str:
    """CTE ``rets``: account bars with return, peak, drawdown and bars since the peak."""
    by = f"PARTITION BY {keys} ORDER BY bar_no"
    upto = f"({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
rets1 AS MATERIALIZED (
  SELECT *, equity / COALESCE(LAG(equity) OVER ({by}), {capital!r}) - 1 AS ret,
         1 - equity / MAX(equity) OVER {upto} AS drawdown FROM acct),
rets AS MATERIALIZED (
  SELECT *, bar_no - MAX(CASE WHEN drawdown <= 1e-9 THEN bar_no END) OVER {upto} AS underwater,
         LAST_VALUE(equity) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS end_equity,
         COUNT(*) OVER (PARTITION BY {keys}) AS bars
  FROM rets1)"""


def deviation(kind: str, x: str, where: str = "") -> str:
    """A deviation, NULL where the values differ by rounding alone."""
    return f"CASE WHEN {kind}({x}){where} > 1e-12 * AVG(ABS({x})){where} THEN {kind}({x}){where} END"


RF = repr(1.01 ** (1 / 252) - 1)


def results(keys: str = "symbol, strategy", capital: float = 1000.0) -> str:
    """CTE ``res``: unrounded metrics per key."""
    c = repr(capital)
    return f"""
res1 AS (
  SELECT {keys}, COUNT(*) AS n, LN(MAX(end_equity) / {c}) AS total_return,
    EXP(LN(MAX(end_equity) / {c}) * 252 / COUNT(*)) - 1 AS annual_return,
    AVG(ret - {RF}) / {deviation('STDDEV_POP', f'ret - {RF}')} AS sharpe_daily,
    0.0 - MAX(drawdown) AS max_drawdown, -MAX(underwater) AS time_dd,
    STDDEV_SAMP(equity / ({c} * EXP(LN(end_equity / {c}) / bars * bar_no)) - 1) AS gap,
    CASE WHEN COUNT(*) FILTER (ret < -1e-12) = 0 THEN 'Infinity'::DOUBLE
         WHEN COUNT(*) FILTER (ret < -1e-12) > 1
         THEN AVG(ret) / {deviation('STDDEV_SAMP', 'ret', ' FILTER (ret < -1e-12)')} * SQRT(252) END AS sortino,
    COUNT(*) FILTER (act = 1) AS trades_total, COUNT(*) FILTER (pnl_net >= 0) AS won,
    COALESCE(SUM(pnl_net) FILTER (pnl_net >= 0), 0) / ABS(SUM(pnl_net) FILTER (pnl_net < 0)) AS profit_factor,
    AVG(pnl_net) AS avg_trade_pl,
    SQRT(COUNT(pnl_net)) * AVG(pnl_net) / {deviation('STDDEV_POP', 'pnl_net')} AS sqn
  FROM rets GROUP BY {keys}),
res AS (
  SELECT *, sharpe_daily * SQRT(252) AS sharpe_annual, annual_return / NULLIF(ABS(max_drawdown), 0) AS calmar,
    100 * annual_return * (1 - (gap / 0.20) ** 2) AS vwr, won / NULLIF(trades_total, 0) AS win_rate
  FROM res1)"""
