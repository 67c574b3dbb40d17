"""Quantiles at any scale, regressions and pair correlations against numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import research as rs
from tickloom.operators.risk import exact_quantile, var_cvar_levels

START = dt.datetime(2000, 1, 1)


@pytest.mark.parametrize("q", [0.0, 0.01, 0.05, 0.5, 0.99, 1.0])
def test_quantiles_of_any_scale(spark, q):
    rng = np.random.default_rng(3)
    series = {"quiet": rng.normal(0, 1e-9, 9000), "loud": rng.normal(0, 1e6, 5000), "one": np.array([4.0]), "two": np.array([1.0, 2.0]),
              "same": np.full(700, 0.25), "ties": rng.choice([-1.0, 0.0, 0.5], 3000)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in series.items() for x in xs] + [("two", None)], "k string, v double").repartition(5)
    got = {r.k: r["quantile"] for r in exact_quantile(df, ["k"], "v", q).collect()}
    for k, xs in series.items():
        assert got[k] == pytest.approx(np.quantile(xs, q), rel=1e-12, abs=1e-30)


def test_levels(spark):
    rng = np.random.default_rng(4)
    rows = [(s, y, float(x)) for s in "AB" for y in (1999, 2000) for x in rng.normal(0, 0.01, 400)]
    table = var_cvar_levels(spark.createDataFrame(rows, "symbol string, year int, bar_ret double"), (("symbol", "year"), ("symbol",), ()))
    for r in table.collect():
        xs = np.array([x for s, y, x in rows if r.symbol in (None, s) and r.year in (None, y)])
        var = np.quantile(xs, 0.05)
        assert (r["var"], r.cvar) == (pytest.approx(var), pytest.approx(xs[xs <= var + 1e-12].mean()))
    assert table.count() == 7


def test_regression(spark):
    rng = np.random.default_rng(5)
    n = 300
    x = rng.normal(0, 0.01, (n, 3))
    ys = {"A": 0.001 + x @ [1.5, -0.5, 0.2] + rng.normal(0, 0.002, n), "B": x @ [0.0, 2.0, 0.0], "few": rng.normal(0, 1, 3)}
    days = [START + dt.timedelta(days=i) for i in range(n)]
    returns = spark.createDataFrame([(s, d, float(y)) for s, v in ys.items() for d, y in zip(days, v)], "symbol string, ts timestamp, bar_ret double")
    factors = spark.createDataFrame([(d, *map(float, r), float(r[0]) * 2) for d, r in zip(days, x)], "ts timestamp, a double, b double, c double, twice double")
    got = {r.symbol: r for r in rs.factor_regression(returns, factors, ["a", "b", "c"]).collect()}
    for s in "AB":
        design = np.c_[np.ones(n), x]
        beta = np.linalg.lstsq(design, ys[s], rcond=None)[0]
        assert [got[s].alpha, got[s].beta_a, got[s].beta_b, got[s].beta_c] == pytest.approx(beta, abs=1e-9)
        assert got[s].r2 == pytest.approx(1 - ((ys[s] - design @ beta) ** 2).sum() / ((ys[s] - ys[s].mean()) ** 2).sum(), abs=1e-9)
    assert got["few"].beta_a is None and got["few"].n == 3
    both = rs.factor_regression(returns, factors, ["a", "twice"]).collect()
    assert {r.beta_twice for r in both} == {None}


@pytest.mark.parametrize("days", [7, 2000])
def test_correlations_over_slices(spark, days, monkeypatch):
    monkeypatch.setattr(rs, "DAYS", days)
    rng = np.random.default_rng(6)
    base = rng.normal(0, 0.01, 90)
    series = {f"s{i}": 5 * (i == 2) + base * rng.random() + rng.normal(0, 0.01, 90) for i in range(6)} | {"flat": np.full(90, 0.1 / 3)}
    rows = [(s, START + dt.timedelta(days=i), float(x)) for s, xs in series.items() for i, x in enumerate(xs) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, bar_ret double")
    got = {(r.a, r.b): r for r in rs.asset_correlation(df, 30, assets=2).collect()}
    by = {}
    for s, ts, x in rows:
        by.setdefault(s, {})[ts] = x
    for a in by:
        for b in by:
            common = sorted(by[a].keys() & by[b].keys())
            if a < b and len(common) >= 30:
                r = got.pop((a, b))
                assert r.days == len(common)
                if "flat" in (a, b):
                    assert r.correlation is None
                else:
                    assert r.correlation == pytest.approx(np.corrcoef([by[a][t] for t in common], [by[b][t] for t in common])[0, 1], abs=1e-9)
    assert not got


def test_correlation_of_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(rs.correlation(F.col("a"), F.col("b"))).first()[0] is None


def test_correlation_matrix_of_many_names(spark):
    """Every pair of 18 columns over the rows that have both, from rows spread over tasks; a constant and a missing one give NULL."""
    rnd = np.random.default_rng(8)
    values = 1e4 + rnd.normal(size=(300, 18)).cumsum(0)
    values[:, 3] = 7.5
    here = rnd.random(values.shape) < 0.8
    here[:, 5] = False
    rows = [(i, f"r{j:02}", float(values[i, j])) for i in range(300) for j in range(18) if here[i, j]]
    names = [f"r{j:02}" for j in range(18)]
    long = spark.createDataFrame(rows, "k int, name string, value double").repartition(6, "k")
    table = rs.correlation_matrix(long, ["k"], "name", "value", names)
    aggregates = table._jdf.queryExecution().optimizedPlan().toString().count("covar")
    assert aggregates == 0          # 153 covariances and 612 other aggregates before
    got = {(r.a, r.b): r.correlation for r in table.collect()}
    assert len(got) == 153
    for i in range(18):
        for j in range(i + 1, 18):
            both = here[:, i] & here[:, j]
            if {i, j} & {3, 5}:
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(values[both, i], values[both, j])[0, 1], abs=1e-9)


def test_correlation_matrix_without_rows(spark):
    table = rs.correlation_matrix(spark.createDataFrame([], "k int, name string, value double"), ["k"], "name", "value", ["x", "y"])
    assert [tuple(r) for r in table.collect()] == [("x", "y", None)]
