"""Returns that never move have no Sharpe ratio in either layout; printed numbers round as their exact value does."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators.metrics import results
from tickloom.operators.research import benchmark_compare
from tickloom.operators.risk import rolling_sharpe_vol
from tickloom.operators.targets import format_value, two_decimals
from tickloom.plans.backtest import run
from tickloom.plans.layout import Layout, lay_out

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


@pytest.mark.parametrize("whole", [True, False])
def test_flat_account(spark, whole):
    rnd, rows = random.Random(1), []
    for i in range(500):
        price = 100 + rnd.random()
        rows.append(("A", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), price, price + 1, price - 1, price, 5))
    df, lay = lay_out(spark.createDataFrame(rows, SCHEMA), whole, 70, 64, back=1700)
    row = results(*run(df, lay, "MonthlyRotator")).withColumn("n", F.col("trades_total")).first()
    if row["n"] == 0:
        assert row["sharpe_daily"] is None and row["sharpe_annual"] is None
    flat = results(*run(df.withColumns({c: F.lit(7.0) for c in ("open", "high", "low", "close")}), lay, "DonchianTurtle"))
    assert flat.filter("sharpe_daily is null or abs(sharpe_daily) < 1e6").count() == 1


def test_flat_returns_in_frames(spark):
    rows = [("A", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), i + 1, 0.1 / 3) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, bar_no long, bar_ret double")
    assert {r[0] for r in rolling_sharpe_vol(df, Layout()).select("rolling_sharpe").collect()} == {None}
    bench = df.select("ts", (F.col("bar_ret") - 0.01).alias("bench_ret"))
    row = benchmark_compare(df, bench).first()
    assert row["information_ratio"] is None and row["correlation"] is None


def test_two_decimals(spark):
    rnd = random.Random(2)
    values = [0.0, -0.0, 2.675, 28.125, 0.125, -0.375, 1.005, 0.285, 1e-9, -1e-9, 0.005, 0.015, 0.045, 99.995, 1e6 + 0.125, -2.5e9 - 0.005]
    values += [rnd.choice([1, -1]) * rnd.randrange(10**6) / 1000 for _ in range(3000)]
    values += [rnd.randrange(10**6) / 8 for _ in range(500)] + [rnd.gauss(0, 10.0 ** rnd.randint(-3, 9)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", two_decimals(F.col("v")).alias("s"), format_value(F.col("v"), F.lit(True)).alias("p")).collect()
    for r in got:
        if r.v == 0 or round(abs(r.v), 9) > 0.004:
            assert r.s == f"{abs(r.v) if r.v == 0 else r.v:.2f}"
            assert r.p == f"{abs(r.v) if r.v == 0 else r.v:.2%}"


def test_unprintable(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (3e12,)], "v double")
    assert [r[0] for r in df.select(two_decimals(F.col("v"))).collect()] == ["Infinity", "NaN", None, "3000000000000.00"]
