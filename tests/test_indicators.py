"""Smoothing over many blocks, crosses and edge cases against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators.custom import custom_indicator
from tickloom.operators.smoothing import exponential, smooth, wilder
from tickloom.plans.layout import lay_out, own_rows

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


def frame(spark, symbol_closes, volume=lambda i: 5):
    rows = [
        (s, dt.datetime(1990, 1, 1) + dt.timedelta(days=i), c, c + 1, c - 1, c, volume(i))
        for s, closes in symbol_closes.items() for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed):
    rnd, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        price = max(1.0, price + rnd.gauss(0, 1))
        out.append(price)
    return out


def recursion(xs, keep, period):
    out, y = [], None
    for i, x in enumerate(xs):
        if i == period - 1:
            y = sum(xs[:period]) / period
        elif i >= period:
            y = keep * y + (1 - keep) * x
        out.append(y)
    return out


def values(df, lay, column):
    rows = own_rows(df, lay).select("symbol", "bar_no", column).collect()
    return {(r[0], r[1]): r[2] for r in rows}


@pytest.mark.parametrize("whole", [True, False])
def test_smoothing_over_blocks(spark, whole):
    series = {"A": walk(3000, 1), "B": walk(700, 2), "C": walk(5, 3)}
    df, lay = lay_out(frame(spark, series), whole, chunk_rows=800, back=2000)
    wanted = {
        "e26": exponential(F.col("close"), 26), "w2": wilder(F.col("close"), 2), "w30": wilder(F.col("close"), 30),
        "w1": wilder(F.col("close"), 1), "e200": exponential(F.col("close"), 200),
    }
    df = smooth(df, lay, wanted if whole else {k: v for k, v in wanted.items() if k != "e200"})
    df = df.cache()
    for name, s in wanted.items():
        if name not in df.columns:
            continue
        got = values(df, lay, name)
        for symbol, closes in series.items():
            for i, y in enumerate(recursion(closes, s.keep, s.period)):
                if y is None:
                    assert got[symbol, i + 1] is None
                else:
                    assert got[symbol, i + 1] == pytest.approx(y, rel=1e-11)


def test_slow_smoothing_equals_the_recursion(spark):
    closes = walk(1600, 5)
    df, lay = lay_out(frame(spark, {"A": closes}), True)
    smoothing = exponential(F.col("close"), 700)
    got = values(smooth(df, lay, {"x": smoothing}), lay, "x")
    for i, y in enumerate(recursion(closes, smoothing.keep, 700)):
        assert got["A", i + 1] is None if y is None else got["A", i + 1] == pytest.approx(y, rel=1e-11)


def test_custom_indicator_refuses_a_long_look_back(spark):
    df, lay = lay_out(frame(spark, {"A": [1.0] * 30}), False, 10, 8, back=5)
    with pytest.raises(ValueError, match="total"):
        custom_indicator(df, lay, "total", 30, lambda bars: bars["close"].cumsum())


def test_composed_frames_equal_direct_frames(spark):
    df, lay = lay_out(frame(spark, {"A": walk(400, 7)}), True)
    df = ind.with_extremes(ind.with_smas(df, lay, 20, 50, 200), lay, 9, 14, 26, 52)
    direct = {f"hh{n}": ind.highest(lay, n) for n in (9, 14, 26, 52)} | {f"ll{n}": ind.lowest(lay, n) for n in (9, 14, 26, 52)}
    for n in (20, 50, 200):
        direct[f"sma{n}"] = ind.sma(lay, n)
    df = df.withColumns({f"d_{k}": c for k, c in direct.items()})
    for k in direct:
        assert df.filter(~F.col(k).eqNullSafe(F.col(f"d_{k}")) & (F.abs(F.col(k) - F.col(f"d_{k}")) > 1e-10)).count() == 0
        assert df.filter(F.col(k).isNull() != F.col(f"d_{k}").isNull()).count() == 0


def test_cross_skips_equal_bars(spark):
    closes = [9.0, 10.0, 10.0, 11.0, 10.0, 11.0, 10.0, 9.0, 10.0, 10.0, 12.0]
    df, lay = lay_out(frame(spark, {"A": closes}), True)
    got = values(ind.with_crosses(df, lay, {"x": F.col("close") - 10.0}), lay, "x")
    assert [got["A", i + 1] for i in range(len(closes))] == [0, 0, 0, 1, 0, 0, 0, -1, 0, 0, 1]


def test_nothing_traded_and_flat_prices(spark):
    df, lay = lay_out(frame(spark, {"A": [7.0] * 30}, volume=lambda i: 0), True)
    got = values(ind.with_vwap(df, lay), lay, "vwap")
    assert set(got.values()) == {7.0}
    df = ind.with_rsi(df.withColumns({"high": F.col("close"), "low": F.col("close")}), lay, 2)
    assert {v for (_, n), v in values(df, lay, "rsi2").items() if n > 2} == {50.0}
    df = ind.with_rule_indicators(df.drop("rsi2"), lay, ["sto_k", "adx14", "cross_macd"])
    assert set(values(df, lay, "sto_k").values()) == {None}
    assert {v for (_, n), v in values(df, lay, "adx14").items() if n >= 28} == {0.0}
