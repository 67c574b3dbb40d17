"""Permutation p-values of 1,000 orders against plain loops."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from compare import assert_same

from tickloom.catalog import CHECKS, QUERIES
from tickloom.catalog import research as catalog
from tickloom.operators.permutation import mixed, permutation_test
from tickloom.operators.rules import RULES
from tickloom.plans.backtest import run
from tickloom.plans.layout import Layout


def mix(x):
    x ^= x >> 16
    x = x * 0x85EBCA6B & 0xFFFFFFFF
    x ^= x >> 13
    x = x * 0xC2B2AE35 & 0xFFFFFFFF
    return x ^ x >> 16


def by_loop(name, bars, repetitions):
    """bars: (number, held, return)."""
    seed = int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
    n, stat, wins = sum(h for _, h, _ in bars), sum(x for _, h, x in bars if h), 0
    for rep in range(1, repetitions + 1):
        order = sorted((mix(mix((i + seed) & 0xFFFFFFFF) ^ mix(rep)), x) for i, _, x in bars)
        wins += sum(x for _, x in order[:n]) >= stat - 1e-9
    return n, stat, (wins + 1) / (repetitions + 1)


def test_mixing_is_one_to_one():
    xs = np.arange(200_000)
    assert len(set(mixed(xs).tolist())) == len(xs)
    assert mixed(xs[:50]).tolist() == [mix(x) for x in range(50)]


def test_p_values(spark, folder):
    got = {r.symbol: r for r in QUERIES["permutation_test"](spark, folder).collect()}
    assert min(r.p_value for r in got.values()) >= round(1 / 1001, 6)
    df, _ = run(*catalog._returns(spark, folder), "GoldenCross", keep=("bar_ret",))
    bars = {}
    for r in df.select("symbol", "bar_no", "pos", "bar_ret").collect():
        if r.bar_ret is not None:
            bars.setdefault(r.symbol, []).append((r.bar_no, r.pos == 1, r.bar_ret))
    traded = sorted(s for s, rows in bars.items() if any(h for _, h, _ in rows))
    for symbol in traded[:3]:
        n, _, p = by_loop(f"{symbol}|GoldenCross", bars[symbol], 1000)
        assert got[symbol].n_long == n
        assert got[symbol].p_value == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("chunk", [None, 37, 1000])
def test_both_layouts(spark, chunk):
    rnd, rows = random.Random(5), []
    series = {"A": (400, 0.3), "B": (90, 0.0), "C": (90, 1.0), "D": (3, 0.5), "E": (700, 0.02)}
    for name, (size, share) in series.items():
        rows += [(name, i + 1, dt.datetime(2000, 1, 1) + dt.timedelta(days=i), int(rnd.random() < share),
                  None if i == 0 else rnd.choice([rnd.gauss(0, 0.01), 0.001]), i // (chunk or 10**9)) for i in range(size)]
    df = spark.createDataFrame(rows, "symbol string, bar_no long, ts timestamp, pos int, bar_ret double, chunk long")
    got = {r.symbol: r for r in permutation_test(df, Layout(chunked=chunk is not None), 200).collect()}
    assert len(got) == len(series)
    for name in series:
        bars = [(n, p == 1, x) for s, n, _, p, x, _ in rows if s == name and x is not None]
        n, stat, p = by_loop(name, bars, 200)
        assert (got[name].n_long, got[name].p_value) == (n, pytest.approx(p)) and got[name].stat == pytest.approx(stat)


def test_families_are_never_zero(spark, folder):
    rows = QUERIES["multiple_test_adjust"](spark, folder).collect()
    ps = sorted(r.p_value for r in rows)
    for r in rows:
        assert r.p_bonferroni == pytest.approx(min(1.0, r.p_value * len(ps)), abs=1e-4)
        later = [p * len(ps) / sum(q <= p for q in ps) for p in ps if p >= r.p_value]
        assert r.p_bh == pytest.approx(min(1.0, *later), abs=1e-4)
        assert r.p_bh > 0


def test_all_rules_are_correlated(spark, duck, folder):
    df = QUERIES["correlation_all_rules"](spark, folder)
    assert_same(df, duck, CHECKS["correlation_all_rules"])
    assert df.count() == len(RULES) * (len(RULES) - 1) // 2
