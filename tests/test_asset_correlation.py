"""Pairs of symbols: nothing that is written grows with the pairs, and odd rows count as they did."""

import datetime as dt

import numpy as np
import pytest

from tickloom.operators import research

START = dt.datetime(2000, 1, 1)
SCHEMA = "symbol string, ts timestamp, bar_ret double"


def test_pairs_are_neither_copied_nor_summed_by_a_shuffle(spark):
    rows = [(f"s{i}", START + dt.timedelta(days=d), float((i * d) % 7)) for i in range(6) for d in range(40)]
    table = research.asset_correlation(spark.createDataFrame(rows, SCHEMA), 30, assets=2)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Aggregate [a" not in plan      # a copy of each bar per block, a row per pair and slice before
    assert table.count() == 15


@pytest.mark.parametrize("days, assets", [(5, 2), (5, 400), (2000, 3), (2000, 400)])
def test_odd_returns(spark, monkeypatch, days, assets):
    """Null symbols, times and returns do not count, repeated days count as their mean, a symbol with NaN is left out, infinity gives NaN."""
    monkeypatch.setattr(research, "DAYS", days)
    rng = np.random.default_rng(5)
    series = {f"s{i}": rng.normal(0, 0.01, 50) for i in range(5)}
    rows = [(s, START + dt.timedelta(days=d), float(x)) for s, xs in series.items() for d, x in enumerate(xs)]
    rows += [("s0", START + dt.timedelta(days=3), float(series["s0"][3]) + 2e-3), (None, START, 1.0), ("s1", None, 0.5), ("s2", START + dt.timedelta(days=3), None)]
    rows += [("nan", START + dt.timedelta(days=d), float("nan") if d == 7 else 0.1 * d) for d in range(50)]
    rows += [("inf", START + dt.timedelta(days=d), float("inf") if d == 7 else 0.1 * d) for d in range(50)]
    rows += [("flat", START + dt.timedelta(days=d), 0.1 / 3) for d in range(50)]
    series["s0"] = series["s0"].copy()
    series["s0"][3] += 1e-3
    got = {(r.a, r.b): r for r in research.asset_correlation(spark.createDataFrame(rows, SCHEMA), 30, assets=assets).collect()}
    for i in range(5):
        for j in range(i + 1, 5):
            r = got.pop((f"s{i}", f"s{j}"))
            assert r.days == 50 and r.correlation == pytest.approx(np.corrcoef(series[f"s{i}"], series[f"s{j}"])[0, 1], abs=1e-9)
        assert got["flat", f"s{i}"].days == 50 and got.pop(("flat", f"s{i}")).correlation is None
        assert got["inf", f"s{i}"].days == 49 and np.isnan(got.pop(("inf", f"s{i}")).correlation)
    assert got.pop(("flat", "inf")).correlation is None
    assert not got


def test_no_rows_and_other_keys(spark):
    assert research.asset_correlation(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(k, START + dt.timedelta(days=d), float((k * d) % 5)) for k in (10, 9, 100) for d in range(31)]
    table = research.asset_correlation(spark.createDataFrame(rows, SCHEMA.replace("string", "int", 1)), 30, assets=1)
    assert sorted((r.a, r.b) for r in table.collect()) == [(9, 10), (9, 100), (10, 100)]
