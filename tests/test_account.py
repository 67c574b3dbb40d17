"""Positions, equity and metrics against a plain order-by-order loop."""

import datetime as dt
import math
import random

import pytest

from tickloom.operators.metrics import result_table, results
from tickloom.operators.positions import Account, trades, with_equity, with_fills, with_position, with_returns
from tickloom.plans.layout import lay_out, own_rows

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume long, entry boolean, exit boolean"


def bars(symbol, n, seed, jumpy=False):
    rnd = random.Random(seed)
    price, rows = 100.0, []
    for i in range(n):
        price = max(1.0, price * (1 + rnd.gauss(0, 0.02)))
        open_ = price * (1 + rnd.gauss(0, 0.06 if jumpy else 0.01))      # gaps make orders too dear
        high, low = max(open_, price) * 1.01, min(open_, price) * 0.99
        rows.append((symbol, dt.datetime(2000, 1, 1) + dt.timedelta(days=i), open_, high, low, price, 10,
                     rnd.random() < 0.2, rnd.random() < 0.2))
    return rows


def loop(rows, a=Account()):
    cash, size, decided, out = a.capital, 0.0, None, []
    for i, (_, _, o, h, l, c, _, entry, leave) in enumerate(rows):
        if decided == "buy":
            fill = min(h, o * (1 + a.slippage))
            want = a.stake * cash / rows[i - 1][5]
            if want * fill * (1 + a.commission) <= cash:
                cash, size = cash - want * fill * (1 + a.commission), want
        elif decided == "sell":
            cash, size = cash + size * max(l, o * (1 - a.slippage)) * (1 - a.commission), 0.0
        out.append((1 if size else 0, cash + size * c))
        decided = "buy" if not size and entry else "sell" if size and leave else None
    return out


@pytest.fixture(scope="module")
def data():
    return bars("A", 900, 1) + bars("B", 700, 2, jumpy=True) + bars("ONE", 1, 3) + bars("TWO", 2, 4)


@pytest.mark.parametrize("whole", [True, False])
def test_position_and_equity(spark, data, whole):
    df, lay = lay_out(spark.createDataFrame(data, SCHEMA), whole, chunk_rows=90, back=40, ahead=2)
    df = with_equity(with_position(with_fills(df, lay), lay), lay)
    got = {(r.symbol, r.ts): (r.pos, r.equity) for r in df.collect()}
    assert len(got) == len(data)
    both = refused = 0
    for symbol in ("A", "B", "ONE", "TWO"):
        rows = [r for r in data if r[0] == symbol]
        for row, (pos, equity) in zip(rows, loop(rows)):
            assert got[row[0], row[1]][0] == pos
            assert got[row[0], row[1]][1] == pytest.approx(equity, rel=1e-11)
            both += row[7] and row[8]
    assert both > 20


def test_trades_add_up(spark, data):
    df, lay = lay_out(spark.createDataFrame(data, SCHEMA), True)
    df = with_equity(with_position(with_fills(df, lay), lay), lay)
    net = {}
    for t in trades(df, lay).collect():
        if not t.is_open:
            net[t.symbol] = net.get(t.symbol, 0.0) + t.pnl_net
            assert t.bars_held > 0
    for symbol in ("A", "B"):
        rows = [r for r in data if r[0] == symbol]
        path = loop(rows)
        flat = max(i for i, (pos, _) in enumerate(path) if pos == 0)
        assert 1000.0 + net[symbol] == pytest.approx(path[flat][1], rel=1e-9)


def run_metrics(spark, rows):
    df, lay = lay_out(spark.createDataFrame(rows, SCHEMA), True)
    df = with_returns(with_equity(with_position(with_fills(df, lay), lay), lay), lay)
    return {r.symbol: r for r in results(df, lay).collect()}


def path(symbol, closes, entries=(), exits=()):
    return [
        (symbol, dt.datetime(2000, 1, 1) + dt.timedelta(days=i), c, c, c, c, 1, i in entries, i in exits)
        for i, c in enumerate(closes)
    ]


def test_metric_edges(spark):
    rows = (
        path("IDLE", [10.0] * 6)
        + path("RISE", [10.0, 10.0, 11.0, 12.0, 13.0, 13.0, 13.0], {0}, {4})
        + path("ONELOSS", [10.0, 10.0, 10.0, 12.0, 12.0], {0}, {2})
        + path("OPEN", [10.0, 10.0, 9.0, 8.0, 9.0], {0})
    )
    m = run_metrics(spark, rows)
    idle = m["IDLE"]
    assert (idle.trades_total, idle.win_rate, idle.profit_factor, idle.avg_trade_pl) == (0, None, None, None)
    assert idle.sortino == math.inf and idle.sharpe_daily is None and idle.calmar is None and idle.time_dd == 0
    assert m["RISE"].trades_total == 1 and m["RISE"].win_rate == 1.0 and m["RISE"].profit_factor is None
    assert m["OPEN"].trades_total == 1 and m["OPEN"].win_rate == 0.0 and m["OPEN"].avg_trade_pl is None
    assert m["OPEN"].time_dd == -4


def test_single_loss_has_no_sortino(spark):
    rows = path("S", [10.0, 10.0, 11.0, 10.5, 11.5, 12.0], {0})
    df, lay = lay_out(spark.createDataFrame(rows, SCHEMA), True)
    free = Account(commission=0.0, slippage=0.0)
    df = with_returns(with_equity(with_position(with_fills(df, lay, free), lay, free), lay, free), lay, free)
    assert results(df, lay, free).first().sortino is None


def test_published_columns_and_identities(spark, data):
    df, lay = lay_out(spark.createDataFrame(data, SCHEMA), True)
    df = with_returns(with_equity(with_position(with_fills(df, lay), lay), lay), lay)
    from pyspark.sql import functions as F

    table = result_table(results(df, lay).withColumn("strategy", F.lit("X")))
    assert len(table.columns) == 16
    for r in table.collect():
        if r["Calmar"] is not None:
            assert r["Calmar"] == pytest.approx(r["rnorm100_%"] / abs(r["MaxDrawdown_%"]))
        if r["SharpeAnnual"] is not None:
            assert r["SharpeAnnual"] == pytest.approx(r["SharpeDaily"] * math.sqrt(252))
