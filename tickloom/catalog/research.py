"""Validation, risk and data work on whole tables."""

from __future__ import annotations

import dataclasses
import itertools
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import sql as S
from tickloom.catalog.registry import bars_of, day, laid, laid_in_chunks, query, rounded, rounded_sql
from tickloom.operators import research as rs
from tickloom.operators import risk
from tickloom.operators.adjust import with_adjustment
from tickloom.operators.bootstrap import BLOCK, bootstrap_interval
from tickloom.operators.indicators import with_rule_indicators
from tickloom.operators.metrics import results
from tickloom.operators.paths import path_metrics, rolling_max_drawdown
from tickloom.operators.permutation import REPETITIONS, permutation_test
from tickloom.operators.positions import Account, trade_terms
from tickloom.operators.rules import RULES
from tickloom.operators.variants import Variant, best_variants, grid, sweep, total_returns
from tickloom.plans.backtest import run
from tickloom.plans.layout import Layout, own_rows
from tickloom.plans.log import append_run, read_log
from tickloom.session import new_folder, settle
from tickloom.streaming.versions import as_known_at, deliver
from tickloom.streaming.zones import raw_to_processed

W = S.W
RETS = f"{S.BARS}, rb AS MATERIALIZED (SELECT *, close / {S.lag('close')} - 1 AS bar_ret FROM bars)"


def _returns(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    df, lay = laid(spark, folder)
    return risk.with_bar_returns(df, lay), lay


def _own_returns(spark: SparkSession, folder: str) -> DataFrame:
    return own_rows(*_returns(spark, folder))


# ---- zones and features -----------------------------------------------------

_RAW = f"""
{S.BARS}, raw AS (
  SELECT symbol, day, open, CASE WHEN volume % 37 = 0 THEN NULL WHEN volume % 31 = 0 THEN low - 1 ELSE high END AS high,
         CASE WHEN volume % 29 = 0 THEN -low ELSE low END AS low, close,
         CASE WHEN volume % 23 = 0 THEN -volume ELSE volume END AS volume FROM bars),
judged AS (
  SELECT *, CASE WHEN high IS NULL THEN 'no price' WHEN LEAST(open, high, low, close) <= 0 THEN 'price not positive'
    WHEN high < GREATEST(open, close) OR low > LEAST(open, close) THEN 'range broken'
    WHEN volume < 0 THEN 'bad volume' END AS reason FROM raw)"""


@query("raw_to_processed", f"WITH {_RAW} SELECT symbol, day, close, volume, COALESCE(reason, 'clean') AS zone FROM judged")
def raw_to_processed_query(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("volume")
    raw = bars_of(spark, folder).select(
        "symbol", "ts", "open",
        F.when(v % 37 == 0, None).when(v % 31 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(v % 29 == 0, -F.col("low")).otherwise(F.col("low")).alias("low"),
        "close", F.when(v % 23 == 0, -v).otherwise(v).alias("volume"),
    )
    raw = settle(raw)       # each delivery reads it several times
    twice = raw.unionByName(raw.filter("volume > 0"))       # deliveries repeat
    processed, quarantine = new_folder(spark, "processed"), new_folder(spark, "quarantine")
    raw_to_processed(twice, processed, quarantine, "first")
    raw_to_processed(twice, processed, quarantine, "first")                         # the same delivery again
    raw_to_processed(twice.filter("volume % 2 = 0"), processed, quarantine, "late")    # bars and rejects that are there already
    clean = spark.read.parquet(processed).select(*raw.columns).withColumn("reason", F.lit("clean"))
    rejected = spark.read.parquet(quarantine).select(*clean.columns)
    return clean.unionByName(rejected).select("symbol", day(), "close", "volume", F.col("reason").alias("zone"))


_ADJUSTED = ("factor", "adjusted")
_ADJUST = f"""
WITH {S.BARS}, stepped AS (
  SELECT *, CASE WHEN volume % 97 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS split,
         COALESCE(1 - CASE WHEN volume % 61 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END / {S.lag('close')}, 1.0) AS paid FROM bars),
f AS (
  SELECT *, COALESCE(PRODUCT(paid / split) OVER later, 1.0) AS factor, COALESCE(PRODUCT(split) OVER later, 1.0) AS splits FROM stepped
  WINDOW later AS ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
t AS (SELECT *, close * factor AS adjusted, volume * splits AS adjusted_volume FROM f)
SELECT symbol, day, close, adjusted_volume, {rounded_sql(*_ADJUSTED, digits=8)} FROM t"""


def _adjusted(spark: SparkSession, folder: str, df: DataFrame, lay: Layout) -> DataFrame:
    v = F.col("volume")      # stand-in table of actions: a split or a dividend on some days
    actions = bars_of(spark, folder).filter((v % 97 == 0) | (v % 61 == 0)).select(
        "symbol", day(), F.when(v % 97 == 0, 2.0).alias("ratio"), F.when(v % 61 == 0, 0.5).alias("dividend")
    )
    return with_adjustment(df, lay, actions).select("symbol", day(), "close", "adjusted_volume", *rounded(*_ADJUSTED, digits=8))


@query("adjusted_bars", _ADJUST)
def adjusted_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _adjusted(spark, folder, *laid(spark, folder))


@query("chunked_adjusted_bars", _ADJUST)
def chunked_adjusted_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _adjusted(spark, folder, *laid_in_chunks(spark, folder, back=8))


@query("bar_corrections", f"""
WITH {S.BARS}, clean AS (SELECT * FROM bars WHERE volume % 23 <> 0)
SELECT 'then' AS zone, symbol, day, high, volume FROM clean
UNION ALL SELECT 'now', symbol, day, CASE WHEN volume % 5 = 0 THEN high + 1 ELSE high END, volume FROM clean
UNION ALL SELECT 'version', symbol, day, high, volume FROM clean
UNION ALL SELECT 'version', symbol, day, high + 1, volume FROM clean WHERE volume % 5 = 0
UNION ALL SELECT 'rejected', symbol, day, high, -volume FROM bars WHERE volume % 23 = 0""")
def bar_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """A delivery, the same again, corrections, and these again: what was known then, what is known now, what was refused."""
    v = F.col("volume")
    first = settle(bars_of(spark, folder).withColumn("volume", F.when(v % 23 == 0, -v).otherwise(v)))       # read by every delivery
    corrected = first.filter((v > 0) & (v % 5 == 0)).withColumn("high", F.col("high") + 1)
    zones = [new_folder(spark, name) for name in ("versions", "current", "quarantine")]
    moment = lambda text: F.lit(text).cast("timestamp")
    for rows, known in ((first, "2001-01-01"), (first, "2001-02-01"), (corrected, "2001-03-01"), (corrected, "2001-04-01")):
        deliver(rows, *zones, moment(known))
    versions, current, refused = (spark.read.parquet(z) for z in zones)
    parts = {"then": as_known_at(versions, moment("2001-02-15")), "now": current, "version": versions, "rejected": refused}
    tables = [t.select(F.lit(name).alias("zone"), "symbol", day(), "high", "volume") for name, t in parts.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])


_FEATURES = ("mom_20", "mom_126", "vol_20", "std_20", "trend_50")


@query("feature_table", f"""
WITH {RETS}, f AS (
  SELECT symbol, day, close, close / {S.lag('close', 20)} - 1 AS mom_20, close / {S.lag('close', 126)} - 1 AS mom_126,
    CASE WHEN bar_no > 20 THEN STDDEV_POP(bar_ret) OVER {S.rows(19)} END AS vol_20, {S.std(20)} AS std_20,
    close / {S.sma(50)} - 1 AS trend_50, MONTH(day) AS month, ISODOW(day) - 1 AS weekday FROM rb)
SELECT symbol, day, close, month, weekday, {rounded_sql(*_FEATURES)} FROM f""")
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "features")
    table_ = risk.feature_table(*laid(spark, folder)).withColumn("year", F.year("ts"))
    risk.sink_features(table_, path)
    return spark.read.schema(table_.schema).parquet(path).select(
        "symbol", day(), "close", "month", "weekday", *rounded(*_FEATURES)
    )


@query("seasonal_means", f"""
WITH {RETS} SELECT symbol, MONTH(day) AS month, COUNT(*) AS bars, ROUND(AVG(bar_ret) + 3.3e-10, 8) AS mean_ret
FROM rb WHERE bar_ret IS NOT NULL GROUP BY 1, 2""")
def seasonal_means(spark: SparkSession, folder: str) -> DataFrame:
    means = risk.seasonal_means(_own_returns(spark, folder), F.month("ts").alias("month"))
    return means.select("symbol", "month", "bars", *rounded("mean_ret", digits=8))


# ---- permutation test -------------------------------------------------------

def _mix(x: str, source: str, target: str, kept: str) -> str:
    """CTE ``target``: ``source`` with column ``h``, the 32-bit finaliser of ``x``."""
    return f"""
{target}_1 AS (SELECT {kept}, xor({x}, ({x}) >> 16) AS h FROM {source}),
{target}_2 AS (SELECT {kept}, (h * 2246822507::UBIGINT) & 4294967295 AS h FROM {target}_1),
{target}_3 AS (SELECT {kept}, (xor(h, h >> 13) * 3266489909::UBIGINT) & 4294967295 AS h FROM {target}_2),
{target} AS (SELECT {kept}, xor(h, h >> 16) AS h FROM {target}_3)"""


_SEEDED = "(bar_no + ('0x' || SUBSTR(MD5(symbol || '|' || strategy), 1, 8))::UBIGINT) & 4294967295"
_PERMUTED = f"""
WITH RECURSIVE {S.rule_flags('GoldenCross')}, {S.account()},
pr AS MATERIALIZED (SELECT *, close / LAG(close) OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS bar_ret FROM acct),
stats AS (
  SELECT symbol, COUNT(*) FILTER (pos = 1 AND bar_ret IS NOT NULL) AS n_long,
         COALESCE(SUM(bar_ret) FILTER (pos = 1), 0) AS stat FROM pr GROUP BY 1),
seeded AS (SELECT symbol, bar_ret, {_SEEDED} AS x FROM pr WHERE bar_ret IS NOT NULL),
{_mix('x', 'seeded', 'own', 'symbol, bar_ret')},
numbers AS (SELECT UNNEST(RANGE(1, {REPETITIONS + 1}))::UBIGINT AS rep),
{_mix('rep', 'numbers', 'shuffles', 'rep')},
shuffled AS (SELECT symbol, bar_ret, rep, xor(own.h, shuffles.h) AS x FROM own, shuffles),
{_mix('x', 'shuffled', 'hashed', 'symbol, bar_ret, rep')},
ranked AS (SELECT symbol, rep, bar_ret, ROW_NUMBER() OVER (PARTITION BY symbol, rep ORDER BY h) AS rk FROM hashed),
chance AS (
  SELECT symbol, rep, COALESCE(SUM(bar_ret) FILTER (rk <= n_long), 0) AS by_chance, ANY_VALUE(stat) AS stat
  FROM ranked JOIN stats USING (symbol) GROUP BY 1, 2),
p AS (
  SELECT symbol, (COUNT(*) FILTER (by_chance >= stat - 1e-9) + 1) / {REPETITIONS + 1}.0::DOUBLE AS p_value
  FROM chance GROUP BY 1)"""


def _permuted(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = run(*_returns(spark, folder), "GoldenCross", keep=("bar_ret",))
    return permutation_test(df, lay)


@query("permutation_test", f"""
{_PERMUTED} SELECT symbol, n_long, {rounded_sql('stat', 'p_value')} FROM p JOIN stats USING (symbol)""")
def permutation_test_query(spark: SparkSession, folder: str) -> DataFrame:
    return _permuted(spark, folder).select("symbol", "n_long", *rounded("stat", "p_value"))


@query("multiple_test_adjust", f"""
{_PERMUTED}, ordered AS (
  SELECT *, RANK() OVER (ORDER BY p_value) + COUNT(*) OVER (PARTITION BY p_value) - 1 AS upto, COUNT(*) OVER () AS m FROM p),
adj AS (
  SELECT symbol, p_value, LEAST(1.0::DOUBLE, p_value * m) AS p_bonferroni,
    LEAST(1.0::DOUBLE, MIN(p_value * m / upto) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh
  FROM ordered)
SELECT symbol, {rounded_sql('p_value', 'p_bonferroni', 'p_bh')} FROM adj""")
def multiple_test_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return rs.multiple_test_adjust(_permuted(spark, folder)).select("symbol", *rounded("p_value", "p_bonferroni", "p_bh"))


@query("permutation_test_corrected", f"""
{_PERMUTED}, named AS (SELECT symbol, n_long, stat, p_value AS p_corrected FROM p JOIN stats USING (symbol))
SELECT symbol, n_long, {rounded_sql('stat', 'p_corrected')} FROM named""")
def permutation_test_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The name under which the p-value with the observed order was first published."""
    tests = _permuted(spark, folder).withColumnRenamed("p_value", "p_corrected")
    return tests.select("symbol", "n_long", *rounded("stat", "p_corrected"))


@query("multiple_test_corrected", f"""
{_PERMUTED}, ordered AS (
  SELECT *, RANK() OVER (ORDER BY p_value) + COUNT(*) OVER (PARTITION BY p_value) - 1 AS upto, COUNT(*) OVER () AS m FROM p),
adj AS (
  SELECT symbol, p_value AS p_corrected, LEAST(1.0::DOUBLE, p_value * m) AS p_bonferroni,
    LEAST(1.0::DOUBLE, MIN(p_value * m / upto) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_bh
  FROM ordered)
SELECT symbol, {rounded_sql('p_corrected', 'p_bonferroni', 'p_bh')} FROM adj""")
def multiple_test_corrected(spark: SparkSession, folder: str) -> DataFrame:
    tests = _permuted(spark, folder).withColumnRenamed("p_value", "p_corrected")
    return rs.multiple_test_adjust(tests, "p_corrected").select("symbol", *rounded("p_corrected", "p_bonferroni", "p_bh"))


# ---- bootstrap --------------------------------------------------------------

_DRAWN = 150        # more blocks than any of these series needs
_BOOT = f"""
WITH RECURSIVE {S.rule_flags('DonchianTurtle')}, {S.account()}, {S.returns()},
prefix AS MATERIALIZED (
  SELECT symbol, strategy, bar_no AS place, SUM(LN(1 + ret)) OVER (PARTITION BY symbol ORDER BY bar_no) AS p FROM rets
  UNION ALL SELECT DISTINCT symbol, strategy, 0, 0.0 FROM rets),
series AS (
  SELECT symbol, COUNT(*) AS n, SUM(LN(1 + ret)) AS total_return,
         ('0x' || SUBSTR(MD5(symbol || '|' || strategy), 1, 8))::UBIGINT AS seed FROM rets GROUP BY symbol, strategy),
asked AS (SELECT symbol, n, seed, j, k, (seed + 2 * j + k) & 4294967295 AS x FROM series, (SELECT UNNEST(RANGE(0, {_DRAWN}))::UBIGINT AS j), (VALUES (0::UBIGINT), (1::UBIGINT)) v(k)),
{_mix('x', 'asked', 'own', 'symbol, n, j, k')},
numbers AS (SELECT UNNEST(RANGE(1, {REPETITIONS + 1}))::UBIGINT AS rep),
{_mix('rep', 'numbers', 'repeats', 'rep')},
met AS (SELECT symbol, n, j, k, rep, xor(own.h, repeats.h) AS x FROM own, repeats),
{_mix('x', 'met', 'drawn', 'symbol, n, j, k, rep')},
blocks AS (
  SELECT symbol, ANY_VALUE(n) AS n, rep, j, CAST(MAX(CASE WHEN k = 0 THEN (h * n) >> 32 END) AS BIGINT) AS s,
         MAX(CASE WHEN k = 1 THEN 1 + CAST(FLOOR(LN((h + 1.0::DOUBLE) / 4294967296.0) / {math.log(1 - 1 / BLOCK)!r}::DOUBLE) AS BIGINT) END) AS length
  FROM drawn GROUP BY symbol, rep, j),
filled AS (SELECT *, SUM(length) OVER (PARTITION BY symbol, rep ORDER BY j) - length AS before FROM blocks),
used AS (SELECT *, s + LEAST(length, n - before) AS e FROM filled WHERE before < n),
ends AS (
  SELECT symbol, rep, s AS place, -1 AS sign FROM used UNION ALL
  SELECT symbol, rep, CASE WHEN e > n THEN e - n ELSE e END, 1 FROM used UNION ALL
  SELECT symbol, rep, n, 1 FROM used WHERE e > n),
totals AS (SELECT symbol, rep, SUM(sign * p) AS total FROM ends JOIN prefix USING (symbol, place) GROUP BY 1, 2),
i AS (SELECT symbol, QUANTILE_CONT(total, 0.025) AS low, QUANTILE_CONT(total, 0.975) AS high FROM totals GROUP BY 1)
SELECT symbol, n AS bars, {rounded_sql('total_return', 'low', 'high')} FROM series JOIN i USING (symbol)"""


def _interval(table: DataFrame) -> DataFrame:
    return table.select("symbol", "bars", *rounded("total_return", "low", "high"))


@query("bootstrap_interval", _BOOT)
def bootstrap_interval_query(spark: SparkSession, folder: str) -> DataFrame:
    """95 % of 1,000 series of random blocks, for the account of one rule."""
    return _interval(bootstrap_interval(*run(*laid(spark, folder), "DonchianTurtle")))


@query("chunked_bootstrap", _BOOT)
def chunked_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return _interval(bootstrap_interval(*run(*laid_in_chunks(spark, folder, back=1_700), "DonchianTurtle")))


# ---- folds ------------------------------------------------------------------


@query("walk_forward_split", f"""
WITH {S.BARS}, span AS (SELECT MIN(day) AS lo, MAX(day) AS hi FROM bars),
m AS (SELECT bars.*, DATE_DIFF('month', lo, day) AS month, GREATEST(1, CAST(CEIL((DATE_DIFF('month', lo, hi) + 1 - 24) / 12.0) AS INT)) AS folds FROM bars, span),
placed AS (SELECT *, month - fold * 12 AS into_fold FROM (SELECT *, UNNEST(RANGE(0, folds)) AS fold FROM m))
SELECT symbol, day, fold, CASE WHEN into_fold < 24 THEN 'train' ELSE 'test' END AS part
FROM placed WHERE into_fold BETWEEN 0 AND 35""")
def walk_forward_split(spark: SparkSession, folder: str) -> DataFrame:
    bars = bars_of(spark, folder)
    return rs.walk_forward_split(bars, *rs.walk_forward_span(bars, 24, 12), 24, 12).select("symbol", day(), "fold", "part")


@query("cross_validation_folds", f"WITH {S.BARS} SELECT symbol, day, NTILE(7) OVER ({W}) AS fold FROM bars")
def cross_validation_folds(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = laid(spark, folder)
    return own_rows(rs.cross_validation_folds(df, lay, 7), lay).select("symbol", day(), "fold")


# ---- sweep, stress ----------------------------------------------------------

FAST, SLOW = (10, 20, 30), (20, 50, 100)
_PAIRS = [(f, s) for f, s in itertools.product(FAST, SLOW) if f < s]
_PERIODS = sorted({*FAST, *SLOW})
_SWEEP = f"""
WITH RECURSIVE {S.BARS}, ind AS MATERIALIZED (SELECT *, {', '.join(f'{S.sma(n)} AS sma{n}' for n in _PERIODS)} FROM bars),
{S.crosses('ind', 'crossed', {f'x_{f}_{s}': f'sma{f} - sma{s}' for f, s in _PAIRS})},
flags AS MATERIALIZED ({' UNION ALL '.join(
    f"SELECT symbol, {f} AS fast, {s} AS slow, day, bar_no, open, high, low, close, COALESCE(x_{f}_{s} = 1, FALSE) AS entry, "
    f"COALESCE(x_{f}_{s} = -1, FALSE) AS exit FROM crossed" for f, s in _PAIRS)}),
{S.account(keys='symbol, fast, slow')},
totals AS (SELECT symbol, fast, slow, LN(ARG_MAX(equity, bar_no) / 1000.0) AS total_return FROM acct GROUP BY 1, 2, 3)"""


@query("parameter_sweep", f"""
{_SWEEP}, best AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ROUND(total_return, 9) DESC, fast, slow) AS rn FROM totals)
SELECT symbol, fast, slow, {rounded_sql('total_return')} FROM best WHERE rn = 1""")
def parameter_sweep(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = rs.sma_cross_sweep(*laid(spark, folder), FAST, SLOW)
    return rs.best_parameters(df).select("symbol", "fast", "slow", *rounded("total_return"))


_WALKED = f"""
{_SWEEP}, {S.returns('symbol, fast, slow')}, span AS (SELECT DATE_TRUNC('month', MIN(day)) AS lo, MAX(day) AS hi FROM bars),
spread AS (SELECT lo, GREATEST(1, CAST(CEIL((DATE_DIFF('month', lo, hi) + 1 - 24) / 12.0) AS INT)) AS folds FROM span),
placed AS (
  SELECT symbol, fast, slow, ret, fold, DATE_DIFF('month', lo, day) - 12 * fold AS month
  FROM rets, (SELECT lo, UNNEST(RANGE(0, folds)) AS fold FROM spread)),
scored AS (
  SELECT symbol, fold, fast, slow, COUNT(*) FILTER (month < 24) AS train_bars, SUM(LN(1 + ret)) FILTER (month < 24) AS train_return,
    NULLIF(COUNT(*) FILTER (month >= 24), 0) AS test_bars, SUM(LN(1 + ret)) FILTER (month >= 24) AS test_return,
    CASE WHEN VAR_POP(ret) FILTER (month >= 24) > 1e-12 * AVG(ret * ret) FILTER (month >= 24)
         THEN AVG(ret) FILTER (month >= 24) / STDDEV_POP(ret) FILTER (month >= 24) * SQRT(252) END AS test_sharpe
  FROM placed WHERE month BETWEEN 0 AND 35 GROUP BY ALL HAVING COUNT(*) FILTER (month < 24) > 0),
picked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, fold ORDER BY ROUND(train_return, 9) DESC, fast, slow) AS rn FROM scored)"""
_WALK = ("train_return", "test_return", "test_sharpe")


def _walked(spark: SparkSession, folder: str, df: DataFrame, lay: Layout) -> DataFrame:
    start, folds = rs.walk_forward_span(bars_of(spark, folder), 24, 12)
    swept, _ = rs.sma_cross_sweep(df, lay, FAST, SLOW)
    slices = rs.slice_statistics(swept, ["symbol", "fast", "slow"], start, 12)
    return rs.walk_forward_selection(slices, ["symbol"], ["fast", "slow"], folds, 2, 1)


def _walk_columns(selected: DataFrame) -> DataFrame:
    return selected.select("symbol", "fold", "fast", "slow", "train_bars", "test_bars", *rounded(*_WALK))


@query("walk_forward_selection", f"""
{_WALKED} SELECT symbol, fold, fast, slow, train_bars, test_bars, {rounded_sql(*_WALK)} FROM picked WHERE rn = 1""")
def walk_forward_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters picked on two years, scored on the year after, fold by fold."""
    return _walk_columns(_walked(spark, folder, *laid(spark, folder)))


@query("chunked_walk_forward", f"""
{_WALKED} SELECT symbol, fold, fast, slow, train_bars, test_bars, {rounded_sql(*_WALK)} FROM picked WHERE rn = 1""")
def chunked_walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    return _walk_columns(_walked(spark, folder, *laid_in_chunks(spark, folder, back=120)))


@query("walk_forward_summary", f"""
{_WALKED} SELECT symbol, COUNT(*) AS folds, COUNT(DISTINCT fast * 1000 + slow) AS variants,
  ROUND(SUM(test_return) + 3.3e-8, 6) AS test_return, ROUND(AVG(CASE WHEN test_return > 0 THEN 1.0::DOUBLE ELSE 0.0 END) + 3.3e-8, 6) AS gained
FROM picked WHERE rn = 1 AND test_bars > 0 GROUP BY 1""")
def walk_forward_summary(spark: SparkSession, folder: str) -> DataFrame:
    selected = _walked(spark, folder, *laid(spark, folder))
    return rs.walk_forward_summary(selected, ["symbol"], ["fast", "slow"]).select("symbol", "folds", "variants", *rounded("test_return", "gained"))


_COLUMNS = "symbol, {key}, day, bar_no, open, high, low, close"
_TOTALS = "SELECT symbol, params, LN(ARG_MAX(equity, bar_no) / 1000.0) AS total_return, COUNT(*) FILTER (act = 1) AS trades FROM acct GROUP BY 1, 2"
_OTHER_CROSS = Variant("GoldenCross", (("fast", 20), ("slow", 100)))


@query("rule_parameters", f"""
WITH RECURSIVE {S.BARS}, ind AS MATERIALIZED (SELECT *, {S.sma(20)} AS sma20, {S.sma(100)} AS sma100 FROM bars),
{S.crosses('ind', 'crossed', {'x': 'sma20 - sma100'})},
flags AS MATERIALIZED (SELECT {_COLUMNS.format(key=f"'{_OTHER_CROSS.label}' AS params")}, COALESCE(x = 1, FALSE) AS entry, COALESCE(x = -1, FALSE) AS exit FROM crossed),
{S.account(keys='symbol, params')}, totals AS ({_TOTALS})
SELECT symbol, params, trades, {rounded_sql('total_return')} FROM totals""")
def rule_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """A golden cross of other means."""
    df, _ = sweep(*laid(spark, folder), [Variant.of("GoldenCross", fast=20, slow=100)])
    traded = df.groupBy("symbol", "params").agg(F.count_if("opens").alias("trades"))
    return total_returns(df).join(traded, ["symbol", "params"]).select("symbol", "params", "trades", *rounded("total_return"))


_CHANNELS = grid("DonchianTurtle", period=(10, 20, 55))


def _channel_rows(v: Variant) -> str:
    n = dict(v.params)["period"]
    before = f"(PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    known = f"bar_no > {n} AND"
    return (
        f"SELECT {_COLUMNS.format(key=f'{chr(39)}{v.label}{chr(39)} AS params')}, {known} close >= MAX(high) OVER {before} - 1e-9 AS entry, "
        f"{known} close <= MIN(low) OVER {before} + 1e-9 AS exit FROM bars"
    )


@query("channel_sweep", f"""
WITH RECURSIVE {S.BARS}, flags AS MATERIALIZED ({' UNION ALL '.join(map(_channel_rows, _CHANNELS))}),
{S.account(keys='symbol, params')}, totals AS ({_TOTALS}),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ROUND(total_return, 9) DESC, params) AS rn FROM totals)
SELECT symbol, params, {rounded_sql('total_return')} FROM best WHERE rn = 1""")
def channel_sweep(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = sweep(*laid(spark, folder), _CHANNELS)
    return best_variants(df).select("symbol", "params", *rounded("total_return"))


STRESS = [
    rs.CostVariant("base", 0.001, 0.0005), rs.CostVariant("costly", 0.005, 0.002),
    rs.CostVariant("late", 0.001, 0.0005, delay=2),
]


def _stress_rows(v: rs.CostVariant) -> str:
    ahead = f"LEAD({{c}}, {v.delay - 1}) OVER ({W})"
    prices = ", ".join(f"{ahead.format(c=c)} AS {c}" for c in ("open", "high", "low"))
    return (
        f"SELECT symbol, '{v.name}' AS variant, {v.commission!r}::DOUBLE AS commission, {v.slippage!r}::DOUBLE AS slippage, "
        f"day, bar_no, {prices}, close, entry, exit AND LEAD(open, {v.delay}) OVER ({W}) IS NOT NULL AS exit FROM flags"
    )


@query("cost_stress", f"""
WITH RECURSIVE {S.rule_flags('DonchianTurtle')}, variants AS MATERIALIZED ({' UNION ALL '.join(map(_stress_rows, STRESS))}),
{S.account('variants', 'symbol, variant', commission='commission', slippage='slippage')},
t AS (SELECT symbol, variant, ARG_MAX(equity, bar_no) AS end_equity, COUNT(*) FILTER (act = 1) AS trades FROM acct GROUP BY 1, 2)
SELECT symbol, variant, trades, {rounded_sql('end_equity')} FROM t""")
def cost_stress(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = laid(spark, folder)
    df = with_rule_indicators(df, lay, RULES["DonchianTurtle"]().needs)
    df, lay = rs.cost_stress(df, lay, "DonchianTurtle", STRESS)
    return df.groupBy("symbol", "variant").agg(
        F.max_by("equity", "bar_no").alias("end_equity"), F.count_if("opens").alias("trades")
    ).select("symbol", "variant", "trades", *rounded("end_equity"))


LATE = [rs.CostVariant("late", 0.001, 0.0005, delay=10), rs.CostVariant("costly", 0.005, 0.002)]


@query("chunked_cost_stress", f"""
WITH RECURSIVE {S.rule_flags('DonchianTurtle')}, variants AS MATERIALIZED ({' UNION ALL '.join(map(_stress_rows, LATE))}),
{S.account('variants', 'symbol, variant', commission='commission', slippage='slippage')},
t AS (SELECT symbol, variant, ARG_MAX(equity, bar_no) AS end_equity, COUNT(*) FILTER (act = 1) AS trades FROM acct GROUP BY 1, 2)
SELECT symbol, variant, trades, {rounded_sql('end_equity')} FROM t""")
def chunked_cost_stress(spark: SparkSession, folder: str) -> DataFrame:
    """Fills ten bars later, over keys too large for one task."""
    df, lay = laid_in_chunks(spark, folder, back=30, ahead=10)
    df = with_rule_indicators(df, lay, RULES["DonchianTurtle"]().needs)
    df, lay = rs.cost_stress(df, lay, "DonchianTurtle", LATE)
    return df.groupBy("symbol", "variant").agg(
        F.max_by("equity", "bar_no").alias("end_equity"), F.count_if("opens").alias("trades")
    ).select("symbol", "variant", "trades", *rounded("end_equity"))


# ---- risk -------------------------------------------------------------------


@query("per_year_breakdown", f"""
WITH {RETS}, t AS (
  SELECT symbol, YEAR(day) AS year, COUNT(*) AS bars, SUM(LN(1 + bar_ret)) AS log_return, STDDEV_SAMP(bar_ret) AS volatility
  FROM rb WHERE bar_ret IS NOT NULL GROUP BY ROLLUP (symbol, YEAR(day)))
SELECT symbol, year, bars, {rounded_sql('log_return', 'volatility')} FROM t""")
def per_year_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return risk.per_year_breakdown(_own_returns(spark, folder)).select(
        "symbol", "year", "bars", *rounded("log_return", "volatility")
    )


def _path_sql(source: str, keys: str, year: str) -> str:
    by = f"PARTITION BY {keys} ORDER BY bar_no"
    upto = f"({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
SELECT {keys.split(', ')[0]} AS symbol, {year} AS year, COUNT(*) AS bars, SUM(l) AS log_return, MAX(1 - EXP(LEAST(g - peak, 0))) AS max_drawdown,
  AVG(1 - EXP(LEAST(g - peak, 0))) AS avg_drawdown, MAX(under) AS longest_drawdown, COUNT(*) FILTER (under = 1) AS drawdowns
FROM (
  SELECT *, bar_no - COALESCE(MAX(CASE WHEN g >= peak - 1e-9 THEN bar_no END) OVER {upto}, MIN(bar_no) OVER {upto} - 1) AS under
  FROM (SELECT *, GREATEST(MAX(g) OVER {upto}, 0) AS peak FROM (SELECT *, SUM(l) OVER {upto} AS g FROM {source})))
GROUP BY {keys}"""


_PATHS = ("log_return", "max_drawdown", "avg_drawdown")
_PATH = f"""
WITH {RETS}, own AS MATERIALIZED (SELECT symbol, YEAR(day) AS year, bar_no, LN(1 + bar_ret) AS l FROM rb WHERE bar_ret IS NOT NULL),
market AS MATERIALIZED (
  SELECT NULL::VARCHAR AS symbol, YEAR(day) AS year, ROW_NUMBER() OVER (ORDER BY day) AS bar_no, LN(1 + AVG(bar_ret)) AS l
  FROM rb WHERE bar_ret IS NOT NULL GROUP BY day),
t AS ({' UNION ALL '.join(_path_sql(s, k, y) for s in ('own', 'market') for k, y in (('symbol, year', 'year'), ('symbol', 'NULL')))})
SELECT symbol, CAST(year AS INT) AS year, bars, longest_drawdown, drawdowns, {rounded_sql(*_PATHS)} FROM t"""


def _paths(table: DataFrame) -> DataFrame:
    return table.select("symbol", "year", "bars", "longest_drawdown", "drawdowns", *rounded(*_PATHS))


@query("path_metrics", _PATH)
def path_metrics_query(spark: SparkSession, folder: str) -> DataFrame:
    """Deepest and average fall and the longest time below the peak, per year and symbol, per symbol, for the market."""
    return _paths(path_metrics(*_returns(spark, folder)))


@query("chunked_path_metrics", _PATH)
def chunked_path_metrics(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = laid_in_chunks(spark, folder, back=8)
    return _paths(path_metrics(risk.with_bar_returns(df, lay), lay))


_FRAMES = (20, 60, 252)
_FALLS = [f"max_drawdown_{n}" for n in _FRAMES]


def _fall_sql(n: int) -> str:
    return f"""
f{n} AS (
  SELECT symbol, at, MAX(1 - close / top) AS max_drawdown_{n} FROM (
    SELECT e.symbol, e.bar_no AS at, b.close, MAX(b.close) OVER (PARTITION BY e.symbol, e.bar_no ORDER BY b.bar_no) AS top
    FROM bars e JOIN bars b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no - {n - 1} AND e.bar_no WHERE e.bar_no >= {n})
  GROUP BY 1, 2)"""


_FALLEN = f"""
WITH {S.BARS}, {', '.join(map(_fall_sql, _FRAMES)).replace(' at,', ' spot,').replace('AS at', 'AS spot')}
SELECT b.symbol, day, {rounded_sql(*_FALLS)} FROM bars b
{' '.join(f'LEFT JOIN f{n} ON f{n}.symbol = b.symbol AND f{n}.spot = b.bar_no' for n in _FRAMES)}"""


@query("rolling_max_drawdown", _FALLEN)
def rolling_max_drawdown_query(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_max_drawdown(*laid(spark, folder), *_FRAMES).select("symbol", day(), *rounded(*_FALLS))


@query("chunked_rolling_drawdown", _FALLEN)
def chunked_rolling_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_max_drawdown(*laid_in_chunks(spark, folder, back=251), *_FRAMES).select("symbol", day(), *rounded(*_FALLS))


_ROLLING = "AVG(bar_ret) OVER f AS m, STDDEV_SAMP(bar_ret) OVER f AS sd, AVG(ABS(bar_ret)) OVER f AS size, COUNT(bar_ret) OVER f AS n"


@query("rolling_sharpe_vol", f"""
WITH {RETS}, a AS (SELECT *, {_ROLLING} FROM rb WINDOW f AS {S.rows(59)}),
b AS (SELECT symbol, day, CASE WHEN n = 60 THEN sd * SQRT(252) END AS rolling_vol,
             CASE WHEN n = 60 THEN m / CASE WHEN sd > 1e-12 * size THEN sd END * SQRT(252) END AS rolling_sharpe FROM a)
SELECT symbol, day, {rounded_sql('rolling_vol', 'rolling_sharpe')} FROM b""")
def rolling_sharpe_vol(spark: SparkSession, folder: str) -> DataFrame:
    return risk.rolling_sharpe_vol(*_returns(spark, folder)).select("symbol", day(), *rounded("rolling_vol", "rolling_sharpe"))


@query("var_cvar", f"""
WITH {RETS}, q AS (SELECT symbol, QUANTILE_CONT(bar_ret, 0.05) AS var FROM rb GROUP BY 1),
t AS (SELECT symbol, ANY_VALUE(var) AS var, AVG(bar_ret) FILTER (bar_ret <= var + 1e-12) AS cvar FROM rb JOIN q USING (symbol) GROUP BY 1)
SELECT symbol, {rounded_sql('var', 'cvar', digits=8)} FROM t""")
def var_cvar(spark: SparkSession, folder: str) -> DataFrame:
    return risk.var_cvar(_own_returns(spark, folder), ["symbol"]).select("symbol", *rounded("var", "cvar", digits=8))


_LEVELS = (("symbol", "year"), ("symbol",), ())


def _quantile_rows(level: tuple[str, ...]) -> str:
    by = f" GROUP BY {', '.join(level)}" if level else ""
    on = " AND ".join(f"y.{c} = q.{c}" for c in level) or "true"
    named = ", ".join(f"q.{c}" if c in level else f"NULL AS {c}" for c in ("symbol", "year"))
    keys = "".join(f"{c}, " for c in level)
    return f"""SELECT {named}, ANY_VALUE(var) AS var, AVG(bar_ret) FILTER (bar_ret <= var + 1e-12) AS cvar
FROM y JOIN (SELECT {keys}QUANTILE_CONT(bar_ret, 0.05) AS var FROM y{by}) q ON {on}{' GROUP BY ' + ', '.join(f'q.{c}' for c in level) if level else ''}"""


@query("var_cvar_levels", f"""
WITH {RETS}, y AS MATERIALIZED (SELECT symbol, CAST(YEAR(day) AS INT) AS year, bar_ret / 1000 AS bar_ret FROM rb WHERE bar_ret IS NOT NULL),
t AS ({' UNION ALL '.join(map(_quantile_rows, _LEVELS))})
SELECT symbol, year, {rounded_sql('var', 'cvar', digits=11)} FROM t""")
def var_cvar_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Per symbol and year, per symbol and over all, of returns a thousand times as quiet."""
    quiet = _own_returns(spark, folder).select("symbol", F.year("ts").alias("year"), (F.col("bar_ret") / 1000).alias("bar_ret"))
    return risk.var_cvar_levels(quiet.filter("bar_ret is not null"), _LEVELS).select("symbol", "year", *rounded("var", "cvar", digits=11))


@query("worst_n_day_loss", f"""
WITH {RETS}, s AS (SELECT *, CASE WHEN COUNT(bar_ret) OVER f = 5 THEN SUM(LN(1 + bar_ret)) OVER f END AS span FROM rb WINDOW f AS {S.rows(4)}),
t AS (SELECT symbol, MIN(bar_ret) AS worst_1, EXP(MIN(span)) - 1 AS worst_5 FROM s GROUP BY 1)
SELECT symbol, {rounded_sql('worst_1', 'worst_5', digits=8)} FROM t""")
def worst_n_day_loss(spark: SparkSession, folder: str) -> DataFrame:
    return risk.worst_losses(*_returns(spark, folder)).select("symbol", *rounded("worst_1", "worst_5", digits=8))


_TURTLE = f"WITH RECURSIVE {S.rule_flags('DonchianTurtle')}, {S.account()}, {S.returns()}"


@query("exposure_turnover", f"""
{_TURTLE}, t AS (SELECT symbol, AVG(pos) AS exposure, SUM(traded) / AVG(equity) AS turnover FROM rets GROUP BY 1)
SELECT symbol, {rounded_sql('exposure', 'turnover')} FROM t""")
def exposure_turnover(spark: SparkSession, folder: str) -> DataFrame:
    return risk.exposure_turnover(*run(*laid(spark, folder), "DonchianTurtle")).select("symbol", *rounded("exposure", "turnover"))


_KPIS = ("cagr", "volatility", "hit_rate", "payoff", "expectancy")


@query("cagr_vol_payoff", f"""
{_TURTLE}, t AS (
  SELECT symbol, (MAX(end_equity) / 1000.0) ** (252.0::DOUBLE / COUNT(*)) - 1 AS cagr, STDDEV_SAMP(ret) * SQRT(252) AS volatility,
    COUNT(*) FILTER (pnl_net >= 0) / NULLIF(COUNT(pnl_net), 0) AS hit_rate,
    AVG(pnl_net) FILTER (pnl_net >= 0) / ABS(AVG(pnl_net) FILTER (pnl_net < 0)) AS payoff, AVG(pnl_net) AS expectancy
  FROM rets GROUP BY 1)
SELECT symbol, {rounded_sql(*_KPIS)} FROM t""")
def cagr_vol_payoff(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = run(*laid(spark, folder), "DonchianTurtle")
    return risk.cagr_vol_payoff(df.withColumns(trade_terms(Account())), lay).select("symbol", *rounded(*_KPIS))


_BENCH = ("excess_return", "tracking_error", "information_ratio", "correlation")


@query("benchmark_compare", f"""
WITH {RETS}, mk AS (SELECT day, AVG(bar_ret) AS bench_ret FROM rb WHERE bar_ret IS NOT NULL GROUP BY 1),
t AS (
  SELECT symbol, COUNT(*) AS n, AVG(bar_ret - bench_ret) * 252 AS excess_return,
    STDDEV_SAMP(bar_ret - bench_ret) * SQRT(252) AS tracking_error,
    AVG(bar_ret - bench_ret) * 252 / ({S.deviation('STDDEV_SAMP', 'bar_ret - bench_ret')} * SQRT(252)) AS information_ratio,
    CORR(bar_ret, bench_ret) AS correlation
  FROM rb JOIN mk USING (day) WHERE bar_ret IS NOT NULL GROUP BY 1)
SELECT symbol, n, {rounded_sql(*_BENCH)} FROM t""")
def benchmark_compare(spark: SparkSession, folder: str) -> DataFrame:
    returns = _own_returns(spark, folder).filter("bar_ret is not null").select("symbol", "ts", "bar_ret")
    return rs.benchmark_compare(returns, rs.market_returns(returns)).select("symbol", "n", *rounded(*_BENCH))


_FACTORS = ("market", "spread", "range")
_FACTOR_SQL = f"""
WITH {RETS}, fac AS (
  SELECT day, AVG(bar_ret) AS market, COALESCE(AVG(bar_ret) FILTER (CAST(symbol AS INT) % 2 = 0), 0) - COALESCE(AVG(bar_ret) FILTER (CAST(symbol AS INT) % 2 = 1), 0) AS spread,
         AVG((high - low) / close) AS range FROM rb WHERE bar_ret IS NOT NULL GROUP BY 1),
met AS (SELECT symbol, bar_ret AS y, market AS a, spread AS b, range AS c FROM rb JOIN fac USING (day) WHERE bar_ret IS NOT NULL)"""
_ONE = ("alpha", "beta_market", "r2")


def _factor_table(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    returns = _own_returns(spark, folder).filter("bar_ret is not null")
    even = F.col("symbol").cast("int") % 2 == 0
    part = lambda rows: F.coalesce(F.avg(F.when(rows, F.col("bar_ret"))), F.lit(0.0))
    factors = returns.groupBy("ts").agg(
        F.avg("bar_ret").alias("market"), (part(even) - part(~even)).alias("spread"), F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("range")
    )
    return returns.select("symbol", "ts", "bar_ret"), factors


@query("factor_regression", f"""
{_FACTOR_SQL}, t AS (
  SELECT symbol, COUNT(*) AS n, REGR_INTERCEPT(y, a) AS alpha, REGR_SLOPE(y, a) AS beta_market, REGR_R2(y, a) AS r2 FROM met GROUP BY 1)
SELECT symbol, n, {rounded_sql(*_ONE)} FROM t""")
def factor_regression(spark: SparkSession, folder: str) -> DataFrame:
    returns, factors = _factor_table(spark, folder)
    return rs.factor_regression(returns, factors, ["market"]).select("symbol", "n", *rounded(*_ONE))


_THREE = ("alpha", "beta_market", "beta_spread", "beta_range", "r2")


def _minor(p: str, q: str, r: str) -> str:
    """Determinant of three columns of covariances with a, b and c."""
    m = {k: [f"{k}{i}" for i in "abc"] for k in (p, q, r)}
    (x1, x2, x3), (y1, y2, y3), (z1, z2, z3) = m[p], m[q], m[r]
    return f"({x1} * ({y2} * {z3} - {y3} * {z2}) - {y1} * ({x2} * {z3} - {x3} * {z2}) + {z1} * ({x2} * {y3} - {x3} * {y2}))"


@query("factor_regression_three", f"""
{_FACTOR_SQL}, m AS (
  SELECT symbol, COUNT(*) AS n, AVG(y) AS my, AVG(a) AS ma, AVG(b) AS mb, AVG(c) AS mc, VAR_POP(y) AS yy,
    {', '.join(f'COVAR_POP({p}, {q}) * 1e4 AS {p}{q}' for p in 'yabc' for q in 'abc')} FROM met GROUP BY 1),
s AS (SELECT *, {_minor('y', 'b', 'c')} / {_minor('a', 'b', 'c')} AS beta_market, {_minor('a', 'y', 'c')} / {_minor('a', 'b', 'c')} AS beta_spread,
  {_minor('a', 'b', 'y')} / {_minor('a', 'b', 'c')} AS beta_range FROM m),
t AS (SELECT *, my - beta_market * ma - beta_spread * mb - beta_range * mc AS alpha,
  (beta_market * ya + beta_spread * yb + beta_range * yc) / 1e4 / yy AS r2 FROM s)
SELECT symbol, n, {rounded_sql(*_THREE)} FROM t""")
def factor_regression_three(spark: SparkSession, folder: str) -> DataFrame:
    returns, factors = _factor_table(spark, folder)
    return rs.factor_regression(returns, factors, _FACTORS).select("symbol", "n", *rounded(*_THREE))


CORRELATED = ("BollingerBreakout", "DonchianTurtle", "GoldenCross", "MaEnvelope", "TwelveMonthMomentum")


@query("correlation_matrix", f"""
WITH RECURSIVE {S.rule_flags(*CORRELATED)}, {S.account()}, {S.returns()},
t AS (SELECT x.strategy AS a, y.strategy AS b, CORR(x.ret, y.ret) AS correlation FROM rets x JOIN rets y
      ON x.symbol = y.symbol AND x.bar_no = y.bar_no AND x.strategy < y.strategy GROUP BY 1, 2)
SELECT a, b, {rounded_sql('correlation')} FROM t""")
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = run(*laid(spark, folder), CORRELATED)
    return rs.correlation_matrix(df, ["symbol", "ts"], "strategy", "ret", CORRELATED).select("a", "b", *rounded("correlation"))


_ALL_RULES = tuple(sorted(RULES))


@query("correlation_all_rules", f"""
WITH RECURSIVE {S.rule_flags(*_ALL_RULES)}, {S.account()}, {S.returns()},
t AS (SELECT x.strategy AS a, y.strategy AS b, CORR(x.ret, y.ret) AS correlation FROM rets x JOIN rets y
      ON x.symbol = y.symbol AND x.bar_no = y.bar_no AND x.strategy < y.strategy GROUP BY 1, 2)
SELECT a, b, {rounded_sql('correlation')} FROM t""")
def correlation_all_rules(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = run(*laid(spark, folder), _ALL_RULES)
    return rs.correlation_matrix(df, ["symbol", "ts"], "strategy", "ret", _ALL_RULES).select("a", "b", *rounded("correlation"))


@query("asset_correlation", f"""
WITH {RETS}, t AS (
  SELECT x.symbol AS a, y.symbol AS b, COUNT(*) AS days, CORR(x.bar_ret, y.bar_ret) AS correlation
  FROM rb x JOIN rb y ON x.day = y.day AND x.symbol < y.symbol
  WHERE x.bar_ret IS NOT NULL AND y.bar_ret IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 30)
SELECT a, b, days, {rounded_sql('correlation')} FROM t""")
def asset_correlation(spark: SparkSession, folder: str) -> DataFrame:
    returns = _own_returns(spark, folder).select("symbol", "ts", "bar_ret")
    return rs.asset_correlation(returns, least_common=30).select("a", "b", "days", *rounded("correlation"))


@query("data_quality_stats", f"""
WITH {S.BARS}, g AS (SELECT *, DATE_DIFF('day', {S.lag('day')}, day) AS gap, close / {S.lag('close')} - 1 AS bar_ret FROM bars)
SELECT symbol, COUNT(*) AS bars, ROUND(AVG(CASE WHEN gap > 7 THEN 1.0::DOUBLE WHEN gap IS NOT NULL THEN 0.0 END) + 3.3e-8, 6) AS gap_share,
  MAX(gap) AS longest_gap, COUNT(*) FILTER (high < GREATEST(open, close) OR low > LEAST(open, close)) AS bad_range,
  COUNT(*) FILTER (volume = 0) AS no_volume, COUNT(*) FILTER (ABS(bar_ret) > 0.5) AS split_suspects
FROM g GROUP BY 1""")
def data_quality_stats(spark: SparkSession, folder: str) -> DataFrame:
    table_ = risk.data_quality_stats(*laid(spark, folder))
    return table_.select(
        "symbol", "bars", *rounded("gap_share"), "longest_gap", "bad_range", "no_volume", "split_suspects"
    )


_LOGGED = ("total_return", "max_drawdown", "win_rate")


_ACCOUNT = Account()
_PARAMS = json.dumps(dataclasses.asdict(_ACCOUNT))


@query("run_log", f"""
WITH RECURSIVE {S.rule_flags(*RULES)}, {S.account()}, {S.returns()}, {S.results()}
SELECT 'first' AS run_id, '{_PARAMS}' AS params, symbol, strategy, {rounded_sql(*_LOGGED)} FROM res""")
def run_log(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "runs")
    table_ = results(*run(*laid(spark, folder), account=_ACCOUNT), _ACCOUNT)
    append_run(table_, path, "first", _PARAMS)
    return read_log(spark, path).select("run_id", "params", "symbol", "strategy", *rounded(*_LOGGED))
