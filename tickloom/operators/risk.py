"""Risk, quality and feature tables over bars and returns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.compare import real_deviation, safe_divide
from tickloom.operators.indicators import momentum, rolling_std, sma
from tickloom.operators.positions import Account
from tickloom.plans.layout import Layout, own_rows
from tickloom.session import settle


def with_bar_returns(df: DataFrame, lay: Layout) -> DataFrame:
    """``bar_ret``: close against the previous close, NULL on the first bar."""
    return df.withColumn("bar_ret", safe_divide(F.col("close"), F.lag("close").over(lay.window())) - 1)


def per_year_breakdown(returns: DataFrame) -> DataFrame:
    """Log return, volatility and bars per symbol and year, per symbol, and in all."""
    return (
        returns.filter("bar_ret is not null").withColumn("year", F.year("ts"))
        .rollup("symbol", "year")
        .agg(
            F.count(F.lit(1)).alias("bars"), F.sum(F.log1p("bar_ret")).alias("log_return"),
            F.stddev_samp("bar_ret").alias("volatility"),
        )
    )


def rolling_sharpe_vol(df: DataFrame, lay: Layout, n: int = 60, per_year: int = 252) -> DataFrame:
    frame = lay.rows(n - 1)
    full = F.count("bar_ret").over(frame) == n
    df = df.withColumns({
        "_mean": F.when(full, F.avg("bar_ret").over(frame)),
        "_sd": F.when(full, F.stddev_samp("bar_ret").over(frame)),
        "_size": F.avg(F.abs("bar_ret")).over(frame),
    })
    return own_rows(df, lay).withColumns({
        "rolling_vol": F.col("_sd") * math.sqrt(per_year),
        "rolling_sharpe": safe_divide(F.col("_mean"), real_deviation(F.col("_sd"), F.col("_size"))) * math.sqrt(per_year),
    }).drop("_mean", "_sd", "_size")


SKETCH = 800            # size of the quantile sketch; ranks are off by 0.4 % or so
MARGIN = 0.02           # ranks looked at to each side of the wanted one


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """Interpolated quantile per key without gathering a key's values.

    A mergeable sketch per key brackets the wanted rank, whatever the scale of
    the values.  They are counted below, inside and above the bracket; only
    the parts that hold the wanted ranks are looked at value by value, as
    counts of distinct values, so the result is exact even if the sketch errs.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edge = lambda rank: F.kll_sketch_get_quantile_double("_sketch", F.lit(min(1.0, max(0.0, rank))))
    # sketches merge in no fixed order: written, so that both readers below see the same bracket
    edges = settle(known.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_sketch")).select(
        *keys, edge(q - MARGIN).alias("_from"), edge(q + MARGIN).alias("_to")
    ))
    part = F.when(F.col("_v") < F.col("_from"), 0).when(F.col("_v") <= F.col("_to"), 1).otherwise(2)
    known = known.join(edges, keys).select(*keys, "_v", part.alias("_bucket"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    place = (F.col("_total") - 1) * q
    buckets = (
        known.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_before": before, "_total": total})
        .withColumns({"_low": F.floor(place), "_share": place - F.floor(place)})
        .filter((F.col("_before") <= F.col("_low") + 1) & (F.col("_before") + F.col("_n") > F.col("_low")))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = known.join(buckets.drop("_n"), [*keys, "_bucket"]).groupBy(
        *keys, "_bucket", "_v", "_before", "_low", "_share"
    ).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counted.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    first_beyond = {
        "_a": F.min(F.when(F.col("_upto") > F.col("_low"), F.col("_v"))),
        "_b": F.min(F.when(F.col("_upto") > F.col("_low") + 1, F.col("_v"))),
    }
    found = ranked.groupBy(*keys).agg(
        *[c.alias(n) for n, c in first_beyond.items()], F.first("_share").alias("_share")
    )
    a, b = F.col("_a"), F.coalesce("_b", "_a")
    return found.select(*keys, (a + (b - a) * F.col("_share")).alias("quantile"))


def var_cvar(returns: DataFrame, keys: Sequence[str], q: float = 0.05, value: str = "bar_ret") -> DataFrame:
    """Value at risk (the q quantile) and the mean of what lies at or below it."""
    keys = list(keys)
    cut = exact_quantile(returns, keys, value, q).withColumnRenamed("quantile", "var")
    return returns.filter(F.col(value).isNotNull()).join(cut, keys).groupBy(*keys).agg(
        F.first("var").alias("var"), F.avg(F.when(F.col(value) <= F.col("var") + 1e-12, F.col(value))).alias("cvar")
    )


def var_cvar_levels(returns: DataFrame, levels: Sequence[Sequence[str]], q: float = 0.05, value: str = "bar_ret") -> DataFrame:
    """:func:`var_cvar` for several groupings, as a rollup has them: columns a level does not group by are NULL."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    returns = settle(returns)       # every level reads them
    table = None
    for level in levels:
        rows = returns.withColumn("_all", F.lit(1))
        part = var_cvar(rows, [*level, "_all"], q, value)
        kinds = returns.schema
        part = part.select(*[F.col(c) if c in level else F.lit(None).cast(kinds[c].dataType).alias(c) for c in columns], "var", "cvar")
        table = part if table is None else table.unionByName(part)
    return table


def worst_losses(df: DataFrame, lay: Layout, days: int = 5) -> DataFrame:
    """Worst single-bar and worst ``days``-bar return per key."""
    frame = lay.rows(days - 1)
    df = df.withColumn(
        "_span", F.when(F.count("bar_ret").over(frame) == days, F.sum(F.log1p("bar_ret")).over(frame))
    )
    return own_rows(df, lay).groupBy(*lay.keys).agg(
        F.min("bar_ret").alias("worst_1"), F.expm1(F.min("_span")).alias(f"worst_{days}")
    )


def exposure_turnover(df: DataFrame, lay: Layout, account: Account = Account()) -> DataFrame:
    """Share of bars in the market, and traded value over mean equity."""
    cash = account.capital * F.col("growth")
    bought = F.when(F.col("opens"), cash * account.stake / F.col("close") * F.col("buy_fill"))
    sold = F.when(F.col("closes"), cash * F.col("unit") * F.col("sell_fill"))
    traded = F.coalesce(F.sum(bought), F.lit(0.0)) + F.coalesce(F.sum(sold), F.lit(0.0))
    return df.groupBy(*lay.keys).agg(
        F.avg("pos").alias("exposure"), safe_divide(traded, F.avg("equity")).alias("turnover")
    )


def cagr_vol_payoff(df: DataFrame, lay: Layout, account: Account = Account(), per_year: int = 252) -> DataFrame:
    """Growth, volatility, hit rate, payoff ratio and expectancy per key; reads ``pnl_net`` of closed trades."""
    net = F.col("pnl_net")
    won, lost = F.avg(F.when(net >= 0, net)), F.avg(F.when(net < 0, net))
    return df.groupBy(*lay.keys).agg(
        (F.pow(F.max_by("equity", "bar_no") / account.capital, F.lit(float(per_year)) / F.count(F.lit(1))) - 1).alias("cagr"),
        (F.stddev_samp("ret") * math.sqrt(per_year)).alias("volatility"),
        safe_divide(F.count_if(F.coalesce(net >= 0, F.lit(False))), F.count(net)).alias("hit_rate"),
        safe_divide(won, F.abs(lost)).alias("payoff"),
        F.avg(net).alias("expectancy"),
    )


def data_quality_stats(df: DataFrame, lay: Layout, max_gap_days: int = 7, split_move: float = 0.5) -> DataFrame:
    """Gaps, broken ranges, empty volume and suspected splits per symbol."""
    gap = F.date_diff(F.col("ts").cast("date"), F.lag(F.col("ts").cast("date")).over(lay.window()))
    df = with_bar_returns(df.withColumn("_gap", gap), lay)
    body = F.greatest("open", "close"), F.least("open", "close")
    return own_rows(df, lay).groupBy(*lay.keys).agg(
        F.count(F.lit(1)).alias("bars"),
        F.avg(F.when(F.col("_gap") > max_gap_days, 1.0).when(F.col("_gap").isNotNull(), 0.0)).alias("gap_share"),
        F.max("_gap").alias("longest_gap"),
        F.count_if((F.col("high") < body[0]) | (F.col("low") > body[1])).alias("bad_range"),
        F.count_if(F.col("volume") == 0).alias("no_volume"),
        F.count_if(F.abs("bar_ret") > split_move).alias("split_suspects"),
    )


def feature_table(df: DataFrame, lay: Layout) -> DataFrame:
    """Momentum, volatility, trend and seasonal features per symbol and date."""
    df = with_bar_returns(df, lay)
    df = df.withColumns({
        "mom_20": momentum(lay, 20), "mom_126": momentum(lay, 126),
        "vol_20": F.when(F.col("bar_no") > 20, F.stddev_pop("bar_ret").over(lay.rows(19))),
        "std_20": rolling_std(lay, 20),
        "_sma50": sma(lay, 50),
    })
    return own_rows(df, lay).select(
        *lay.keys, "ts", "close", "mom_20", "mom_126", "vol_20", "std_20",
        (safe_divide(F.col("close"), F.col("_sma50")) - 1).alias("trend_50"),
        F.month("ts").alias("month"), F.weekday("ts").alias("weekday"), "bar_ret",
    )


def seasonal_means(returns: DataFrame, *parts: Column) -> DataFrame:
    """Mean return per symbol and calendar part, e.g. month or weekday."""
    return returns.filter("bar_ret is not null").groupBy("symbol", *parts).agg(
        F.avg("bar_ret").alias("mean_ret"), F.count(F.lit(1)).alias("bars")
    )


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw bars -> clean bars (typed, one per symbol and ts) and the rejected rows with their reason."""
    unpriced = F.exists(F.array("open", "high", "low", "close"), lambda price: price.isNull())
    reason = (
        F.when(F.col("symbol").isNull() | F.col("ts").isNull(), "no key")
        .when(unpriced, "no price")
        .when(F.least("open", "high", "low", "close") <= 0, "price not positive")
        .when(
            (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), "range broken"
        )
        .when(F.col("volume").isNull() | (F.col("volume") < 0), "bad volume")
    )
    judged = raw.withColumn("reason", reason)
    # of bars with the same key the one with the largest values stays, whichever task sees it first
    values = [c for c in raw.columns if c not in ("symbol", "ts")]
    clean = (
        judged.filter("reason is null").groupBy("symbol", "ts")
        .agg(F.max(F.struct(*values)).alias("_row")).select("symbol", "ts", "_row.*").select(*raw.columns)
    )
    return clean, judged.filter("reason is not null")


def sink_features(features: DataFrame, path: str) -> None:
    """Features by year and symbol bucket.

    A folder per symbol and date would mean one file per row for daily bars;
    year folders prune time ranges, and files sorted by symbol let the reader
    skip row groups.  Rebalancing sizes the files at run time.
    """
    (
        features.hint("rebalance", F.col("year"), F.col("symbol"))
        .sortWithinPartitions("year", "symbol", "ts")
        .write.mode("overwrite").partitionBy("year").parquet(path)
    )
