"""What the findings of the round named: work done once, methods short enough to compile, joins that are not needed."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import DataFrame

from tickloom.catalog import research
from tickloom.llm import collocations
from tickloom.operators import permutation, risk
from tickloom.operators.targets import TARGETS, default_targets, unmatched_metrics, with_targets
from tickloom.plans.backtest import signals
from tickloom.plans.layout import lay_out

MOST_BYTECODE = 8_000       # of a method that the JVM compiles


@pytest.fixture(scope="module")
def bars(spark):
    rnd, rows = random.Random(1), []
    for i in range(60):
        price = 100 + rnd.random()
        rows.append(("A", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), price, price + 1, price - 1, price, 5))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long")


def test_stacked_rules_compile(spark, bars):
    df, lay = signals(*lay_out(bars, True))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.sortWithinPartitions("symbol", "strategy", "ts").select("*")._jdf.queryExecution().executedPlan()
        made = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        assert max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())) < MOST_BYTECODE
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_words_are_not_joined_with_their_totals(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "b c a b c", lang) for i in range(30) for lang in ("x", None)], "doc_id long, text string, lang string")
    kinds, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, on=None, how=None: kinds.append(how) or join(self, other, on, how))
    counts, _ = collocations.phrase_counts(docs, "text", "lang", 60, 3, 40)
    assert "left_semi" not in kinds
    assert {tuple(r) for r in counts.select("lang", "phrase", "a").collect()} == {
        (lang, phrase, 60) for lang in ("x", "und") for phrase in ("b", "c", "b c")}


def test_targets_are_broadcast(spark):
    assert [tuple(r) for r in default_targets(spark).collect()] == TARGETS
    metrics = spark.createDataFrame([("Calmar", 1.0), ("Sharpe_Annual", 2.0)], "metric string, value double")
    plan = with_targets(metrics, default_targets(spark))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [r[0] for r in unmatched_metrics(metrics, default_targets(spark)).collect()] == ["Sharpe_Annual"]


def test_bars_are_worked_out_once(spark, folder, monkeypatch):
    settle = research.settle
    for name in ("bar_corrections", "raw_to_processed_query"):
        settled = []
        monkeypatch.setattr(research, "settle", lambda df, seen=settled: seen.append(1) or settle(df))
        getattr(research, name)(spark, folder)
        assert settled


def test_levels_read_written_returns(spark, monkeypatch):
    rows = spark.createDataFrame([("A", 1, 0.1), ("A", 2, -0.1), ("B", 1, 0.2)], "symbol string, year int, bar_ret double")
    settled, settle = [], risk.settle
    monkeypatch.setattr(risk, "settle", lambda df: settled.append(1) or settle(df))
    assert risk.var_cvar_levels(rows, (("symbol", "year"), ("symbol",), ())).count() == 6
    assert settled


def test_smallest_hashes():
    rng = np.random.default_rng(0)
    hashes, returns = rng.permutation(900).reshape(9, 100).astype(np.uint32), rng.normal(size=100)
    plain = lambda h, r, m: r[np.argsort(h, axis=1)[:, :m]].sum(axis=1)
    for m in (1, 37, 99):
        assert np.allclose(permutation._smallest(hashes, returns, m), plain(hashes, returns, m), atol=1e-12)
    returns[int(hashes[0].argmax())] = np.inf
    assert np.isfinite(permutation._smallest(hashes, returns, 5)[0])
    equal = np.zeros((2, 10), np.uint32)
    assert (permutation._smallest(equal, np.ones(10), 4) == 4).all()
