"""What the findings of the round named: rules beside each other, one pass over the bars, chunks that write what is needed."""

import datetime as dt
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import indicators, positions, research
from tickloom.operators.metrics import results
from tickloom.operators.positions import Account, with_equity, with_position, with_returns
from tickloom.operators.rules import RULES
from tickloom.plans import backtest
from tickloom.plans.layout import lay_out

MOST_BYTECODE = 8_000       # of a method that the JVM compiles
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def bars(spark):
    rnd, rows = random.Random(4), []
    for symbol in ("A", "B", None):
        price = 100.0
        for i in range(420):
            price = max(5.0, price + rnd.randint(-3, 3))
            rows.append((symbol, dt.datetime(2000, 1, 1) + dt.timedelta(days=i), price, price + 2, price - 2, price + rnd.choice((0, 1)), rnd.randint(0, 9)))
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df: DataFrame, columns: list[str]) -> list[tuple]:
    found = df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.select(*columns).dtypes]).collect()
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("whole", [True, False])
def test_rules_beside_each_other_equal_rules_as_rows(spark, bars, whole):
    names = ["AtrTrailingTrend", "BuyAndHold", "Rsi2", "RsiStochCombo", "VwapReversion"]
    df, lay = lay_out(bars, whole, 90, 64, back=1_700)
    stacked, per = backtest.signals(df, lay, names)
    wanted = with_returns(with_equity(with_position(stacked, per), per), per)
    got, same = backtest.run(df, lay, names)
    assert same.keys == per.keys and set(got.columns) == set(wanted.columns) - {"_enter", "_leave"}
    columns = [c for c in wanted.columns if c not in ("chunk", "own")]
    assert _rows(got, columns) == _rows(wanted, columns)


def test_all_rules_compile_and_are_not_sorted_as_rows(spark, bars):
    df, lay = lay_out(bars, True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = results(*backtest.run(df, lay))._jdf.queryExecution().executedPlan()
        made = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < MOST_BYTECODE
        assert "Window" not in plan.toString().split("Generate ")[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_entries_and_exits_on_one_bar(spark):
    """Against a plain loop, in chunks that start with flips."""
    rnd = random.Random(9)
    flags = [(rnd.random() < 0.4, rnd.random() < 0.4, rnd.random() < 0.3, rnd.random() < 0.5) for _ in range(200)]
    flags[40:80] = [(True, True, False, False)] * 40
    rows = [("A", i + 1, i // 20, True, *f, 1.0, 1.0, 1.0) for i, f in enumerate(flags)]
    df = spark.createDataFrame(
        rows, "symbol string, bar_no long, chunk long, own boolean, entry_0 boolean, exit_0 boolean, entry_1 boolean, exit_1 boolean, close double, buy_fill double, sell_fill double"
    )
    for chunked in (False, True):
        lay = backtest.Layout(chunked=chunked, order=("bar_no",))
        got = with_position(df, lay, Account(), ["_0", "_1"]).orderBy("bar_no").collect()
        for t in (0, 1):
            held = 0
            for r, f in zip(got, flags, strict=True):
                assert r[f"pos_{t}"] == held
                enter, leave = f[2 * t], f[2 * t + 1]
                opens, closes = not held and enter, bool(held and leave)
                assert (r[f"opens_{t}"], r[f"closes_{t}"]) == (opens, closes)
                held = 1 if opens else 0 if closes else held


def test_chunks_write_no_halo_behind_the_smoothings(spark, bars, monkeypatch):
    written = []
    for module in (indicators, positions):
        settled = module.settled
        monkeypatch.setattr(module, "settled", lambda df, lay, settled=settled: written.append(settled(df, lay)) or written[-1])
    results(*backtest.run(*lay_out(bars, False, 90, 64, back=1_700)))
    vwap, crosses, position, equity = written
    assert crosses.count() == position.count() == equity.count() == bars.filter("symbol is not null").count() < vwap.count()
    assert "hh20" not in crosses.columns and "sma20" not in vwap.columns
    assert len(RULES) == 18 and "strategy" not in position.columns


def test_pairs_of_blocks_are_few_tasks(spark, monkeypatch):
    """A task per pair of blocks would be 81."""
    rows = [(f"s{i}", dt.datetime(2000, 1, 1) + dt.timedelta(days=d), float((i * d) % 7 + d % 3)) for i in range(9) for d in range(40)]
    returns = spark.createDataFrame(rows, "symbol string, ts timestamp, bar_ret double")
    wanted = sorted(map(tuple, research.asset_correlation(returns, 30, assets=9).collect()))
    monkeypatch.setattr(research, "PARTS", 2)
    table = research.asset_correlation(returns, 30, assets=1)
    assert table.rdd.getNumPartitions() == 9
    got = sorted(map(tuple, table.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in wanted] and len(got) == 36
    assert all(a[3] == b[3] or abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, wanted, strict=True))


def test_pairs_of_a_sweep_are_written_beside_each_other(spark, bars, monkeypatch):
    df, lay = lay_out(bars, False, 90, 64, back=120)
    columns = ["symbol", "fast", "slow", "bar_no", "pos", "opens", "closes", "equity", "ret", "drawdown", "underwater"]
    written = []
    for module in (indicators, positions):
        settled = module.settled
        monkeypatch.setattr(module, "settled", lambda df, lay, settled=settled: written.append(settled(df, lay)) or written[-1])
    got, same = research.sma_cross_sweep(df, lay, (5, 10), (20, 50))
    assert [w.count() for w in written] == [840] * 3 and "_part" not in written[0].columns
    monkeypatch.setattr(research, "MOST_BESIDE", 1)
    wanted, per = research.sma_cross_sweep(df, lay, (5, 10), (20, 50))
    assert same.keys == per.keys == ("symbol", "fast", "slow")
    assert _rows(got, columns) == _rows(wanted, columns)
