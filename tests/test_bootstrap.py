"""Bootstrap intervals against plain resampling, in both layouts and over several segments."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_permutation import mix

from tickloom.operators.bootstrap import SEGMENT, _packed, _unpacked, bootstrap_interval
from tickloom.plans.layout import Layout


def by_loop(name, returns, block, repetitions, level):
    seed, n, totals = int(hashlib.md5(name.encode()).hexdigest()[:8], 16), len(returns), []
    for rep in range(1, repetitions + 1):
        drawn = []
        for segment, begin in enumerate(range(0, n, SEGMENT)):
            part, j = [], 0
            while len(part) < min(SEGMENT, n - begin):
                at, chance = (mix(mix((seed + segment * 0x9E3779B9 + 2 * j + k) & 0xFFFFFFFF) ^ mix(rep)) for k in (0, 1))
                start, length = at * n >> 32, 1 + int(math.log((chance + 1) / 2**32) / math.log(1 - 1 / block))
                part += [returns[(start + i) % n] for i in range(length)]
                j += 1
            drawn += part[:min(SEGMENT, n - begin)]
        totals.append(sum(math.log1p(r) for r in drawn))
    return np.quantile(totals, [(1 - level) / 2, (1 + level) / 2])


def frame(spark, series, chunk):
    start = dt.datetime(1900, 1, 1)
    rows = [(s, start + dt.timedelta(hours=i), i + 1, r, i // chunk) for s, xs in series.items() for i, r in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, bar_no long, ret double, chunk long").withColumn("own", F.lit(True))


@pytest.mark.parametrize("chunk", [None, 37, 5000])
def test_intervals(spark, chunk):
    rnd = random.Random(3)
    series = {"A": 400, "B": 30, "C": 1, "D": 700}
    series = {s: [rnd.gauss(0, 0.02) for _ in range(n)] for s, n in series.items()}
    lay = Layout(chunked=chunk is not None, chunk_rows=chunk or 1)
    got = bootstrap_interval(frame(spark, series, chunk or 10**9), lay, block=12, repetitions=120, level=0.9)
    rows = {r.symbol: r for r in got.collect()}
    assert rows.keys() == series.keys()
    for name, xs in series.items():
        assert rows[name].bars == len(xs)
        assert rows[name].total_return == pytest.approx(sum(math.log1p(x) for x in xs))
        assert [rows[name].low, rows[name].high] == pytest.approx(by_loop(name, xs, 12, 120, 0.9), abs=1e-9)


def test_several_segments(spark):
    rnd = random.Random(4)
    series = {"A": [rnd.gauss(0, 0.01) for _ in range(SEGMENT + 3000)]}
    rows = [bootstrap_interval(frame(spark, series, 20_000), Layout(chunked=c, chunk_rows=20_000), block=50, repetitions=6, level=0.5).first() for c in (False, True)]
    wanted = by_loop("A", series["A"], 50, 6, 0.5)
    for r in rows:
        assert [r.low, r.high] == pytest.approx(wanted, abs=1e-8)


@pytest.mark.parametrize("apart", [1, 9, 700])
def test_places_travel_small(apart):
    rnd = np.random.default_rng(5)
    code = rnd.integers(0, 1000 * apart, 1000)
    adds = rnd.random(1000) < 0.5
    packed = _packed(code, adds)
    number, sign = _unpacked(packed)
    assert sorted(zip(number.tolist(), sign.tolist(), strict=True)) == sorted(zip(code.tolist(), (2.0 * adds - 1).tolist(), strict=True))
    assert apart > 9 or len(packed) < 1200      # seven bytes each before


def test_chunks_send_a_row_each(spark):
    """Totals of the repetitions travel as one list per chunk, not as a row per chunk and repetition."""
    rows = bootstrap_interval(frame(spark, {"A": [0.01] * 90, "B": [0.02] * 50}, 30), Layout(chunked=True, chunk_rows=30), block=5, repetitions=40)
    plan = rows._jdf.queryExecution().toString()
    assert "rep#" not in plan and "parts#" in plan
