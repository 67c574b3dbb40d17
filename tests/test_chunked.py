"""Keys too large for one task: the same answers from chunks, halos and carries."""

from functools import partial

import pytest
from compare import assert_same

from tickloom.catalog import CHECKS, QUERIES, registry
from tickloom.operators import research, risk
from tickloom.plans.layout import KeySizes, lay_out, number_rows

NAMES = [
    "bar_number", "sma", "adx", "macd", "cross_signal", "vwap_cumulative", "rsi_stoch_combo", "custom_indicator",
    "trade_pairing", "drawdown_runs", "golden_cross_backtest", "metric_vwr", "metric_sortino", "permutation_test",
    "cross_validation_folds", "cost_stress", "worst_n_day_loss",
]


@pytest.fixture
def huge_keys(monkeypatch):
    monkeypatch.setattr(registry, "sizes", lambda spark, folder: KeySizes(10**9, 10**9))
    monkeypatch.setattr(registry, "lay_out", partial(lay_out, chunk_rows=200, back=2000))


@pytest.mark.parametrize("name", NAMES)
def test_chunked(name, spark, duck, folder, huge_keys):
    assert_same(QUERIES[name](spark, folder), duck, CHECKS[name])


def test_number_rows_ranks_inside_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 1000).alias("v"))
    numbered = number_rows(df, ["k"], ["v"], F.floor(F.col("v") / 100), "n")
    rows = sorted((r.k, r.n, r.v) for r in numbered.collect())
    wanted = []
    for k in (0, 1):
        values = sorted((i * 7919) % 1000 for i in range(1000) if i % 2 == k)
        wanted += [(k, n, v) for n, v in enumerate(values, 1)]
    assert rows == wanted


def test_hot_key_is_spread(spark):
    """One symbol with all rows is cut into many window groups of bounded size."""
    from pyspark.sql import functions as F

    bars = spark.range(5000).select(
        F.lit("HOT").alias("symbol"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(1.0).alias("close")
    )
    df, lay = lay_out(bars, whole=False, chunk_rows=500, back=100, ahead=2)
    sizes = [r["count"] for r in df.groupBy("chunk").count().collect()]
    assert max(sizes) <= 602
    assert len([1 for s in sizes if s >= 500]) == 10
    assert df.filter("own").count() == 5000


def test_exact_quantile_with_ties(spark):
    import numpy as np
    from pyspark.sql import functions as F

    df = spark.range(3000).select(
        (F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, 0.0).otherwise((F.col("id") % 97 - 48) / 1000.0).alias("v")
    )
    pdf = df.toPandas()
    for q in (0.0, 0.05, 0.5, 0.77, 1.0):
        got = {r.k: r["quantile"] for r in risk.exact_quantile(df, ["k"], "v", q).collect()}
        for k, group in pdf.groupby("k"):
            assert got[k] == pytest.approx(float(np.quantile(group.v, q)), abs=1e-12)


def test_multiple_test_adjust_against_loop(spark):
    import random

    rnd = random.Random(5)
    ps = [round(rnd.random() ** 2, 3) for _ in range(200)] + [0.0, 0.01, 0.01, 1.0]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id int, p_value double")
    got = {r.id: (r.p_bonferroni, r.p_bh) for r in research.multiple_test_adjust(df).collect()}
    m, order = len(ps), sorted(range(len(ps)), key=lambda i: ps[i])
    best, wanted = 1.0, {}
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        best = min(best, ps[i] * m / rank)
        wanted[i] = (min(1.0, ps[i] * m), best)
    for i in range(m):
        assert got[i] == pytest.approx(wanted[i], abs=1e-12)


def test_what_a_halo_does_not_hold_is_refused(spark):
    from tickloom.operators import indicators as ind
    from tickloom.operators.positions import with_fills
    from tickloom.plans.layout import Layout

    lay = Layout(chunked=True, back=100, ahead=2)
    bars = spark.createDataFrame([], "symbol string, ts timestamp, open double, high double, low double, close double, bar_no long, block long, chunk long")
    for build in (
        lambda: ind.sma(lay, 102), lambda: ind.bars_back(lay, 101), lambda: ind.with_smas(bars, lay, 50, 200),
        lambda: ind.with_ema(bars, lay, 30), lambda: with_fills(bars, lay, delay=3), lambda: ind.with_adx(bars, lay),
    ):
        with pytest.raises(ValueError, match="bars back"):
            build()
    ind.sma(lay, 101)
    with_fills(bars, lay, delay=2)


@pytest.mark.parametrize("whole", [True, False])
def test_very_short_and_very_long_smoothings(spark, whole):
    """Against the plain recursion, over more bars than the longest warm-up."""
    import random

    from pyspark.sql import functions as F

    from tickloom.operators.smoothing import exponential, smooth, wilder

    rng = random.Random(7)
    closes = [100 + rng.random() * 10 for _ in range(3000)]
    bars = spark.createDataFrame(list(enumerate(closes)), "i int, close double").select(
        F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("i") * 86400).alias("ts"), "close"
    )
    wanted = {"e2": exponential(F.col("close"), 2), "e1000": exponential(F.col("close"), 1000), "w640": wilder(F.col("close"), 640), "e300": exponential(F.col("close"), 300)}
    df, lay = lay_out(bars, whole, chunk_rows=700, back=max(s.reach for s in wanted.values()))
    rows = smooth(df, lay, wanted)
    rows = (rows if whole else rows.filter("own")).orderBy("ts").collect()
    for name, s in wanted.items():
        value = None
        for i, x in enumerate(closes, 1):
            if i == s.period:
                value = sum(closes[:i]) / s.period
            elif i > s.period:
                value = s.keep * value + (1 - s.keep) * x
            got = rows[i - 1][name]
            assert (got is None) == (value is None)
            assert got is None or abs(got - value) < 1e-9


def test_buckets_of_a_dense_month_stay_small(spark):
    """A million bars of one month are not ranked in one group."""
    from pyspark.sql import functions as F

    from tickloom.plans.layout import time_bucket

    bars = spark.range(1_000_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    counts = bars.groupBy(time_bucket(bars, ["symbol"], most=50_000).alias("b")).count()
    assert counts.agg(F.max("count")).first()[0] <= 50_000


def test_few_keys_are_spread_over_rules(spark):
    from pyspark.sql import functions as F

    from tickloom.plans.backtest import signals

    bars = spark.range(400).select(
        F.concat(F.lit("S"), F.col("id") % 2).alias("symbol"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"),
        *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")], F.lit(1).alias("volume"),
    )
    for spread, tasks in ((False, 2), (True, 4)):
        df, _ = signals(*lay_out(bars, True, spread=spread))
        used = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used <= tasks if not spread else used >= tasks


def test_asset_correlation_in_blocks(spark):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    table = pd.DataFrame(rng.normal(size=(60, 7)), columns=list("ABCDEFG"))
    table.iloc[:40, 0] = np.nan
    table["G"] = 1.0
    long = [(s, int(d) * 86400, float(v)) for s in table for d, v in table[s].items() if not np.isnan(v)]
    returns = spark.createDataFrame(long, "symbol string, t long, bar_ret double").select("symbol", F.timestamp_seconds("t").alias("ts"), "bar_ret")
    wanted = table.corr(min_periods=30)
    found = {(r.a, r.b): r for r in research.asset_correlation(returns, 30, assets=2).collect()}
    assert set(found) == {(a, b) for a in "BCDEFG" for b in "BCDEFG" if a < b}
    for (a, b), r in found.items():
        assert r.days == 60 and (r.correlation is None if b == "G" else abs(r.correlation - wanted[a][b]) < 1e-9)


def test_chunks_read_their_bars_once(spark):
    """The span, the starts, the ranks and the counts read written bars, not the bars' own plan four times over."""
    from pyspark.sql import functions as F

    bars = spark.range(500).select(
        (F.col("id") % 3).cast("string").alias("symbol"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(1.0).alias("close")
    )
    df, _ = lay_out(bars, False, 50, 16, 10, 2)
    assert "Range (" not in df._jdf.queryExecution().toString()
    assert df.filter("own").count() == 500
