"""Which symbols, bars and rules a run looks at."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.rules import RULES

MIN_BARS = 252
RECENT_DAYS = 5


def date_range_filter(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from start to end, both included; reaches the scan as a pushed filter."""
    if start:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        bars = bars.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return bars


def min_bars_filter(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    """Bars of symbols with enough history.

    Counts are combined map-side; the semi join leaves a hot symbol to AQE's
    skew splitting instead of a window over all its bars.
    """
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return bars.join(counts.filter(F.col("n") >= least).select("symbol"), "symbol", "left_semi")


def empty_symbol_filter(requested: DataFrame, bars: DataFrame) -> DataFrame:
    return requested.join(bars.select("symbol").distinct(), "symbol", "left_semi")


def available_symbols(bars: DataFrame, days: int = RECENT_DAYS, as_of: str | None = None) -> DataFrame:
    """Symbols with a bar in the last days before ``as_of`` (default: the latest bar of all)."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    until = F.lit(as_of).cast("timestamp") if as_of else last.agg(F.max("last_ts")).scalar()
    return last.filter(F.col("last_ts") >= until - F.make_dt_interval(days=F.lit(days)))


def symbol_dedupe_ordered(requested: DataFrame, position: str) -> DataFrame:
    """Each symbol once, in order of its first occurrence."""
    return requested.groupBy("symbol").agg(F.min(position).alias("first_pos")).orderBy("first_pos")


def config_symbols(configs: DataFrame, text: str = "config") -> DataFrame:
    """Symbols of run configurations in either layout: ``symbols`` (names or
    maps with a ``symbol`` entry) or ``runs``; ``pos`` is the place in the list."""
    body = F.col(text)
    plain = F.from_json(F.get_json_object(body, "$.symbols"), "array<string>")
    names = F.transform(plain, lambda s: F.coalesce(F.get_json_object(s, "$.symbol"), s))
    runs = F.transform(
        F.from_json(F.get_json_object(body, "$.runs"), "array<struct<symbol: string>>"), lambda r: r["symbol"]
    )
    others = [c for c in configs.columns if c != text]
    return configs.select(*others, F.posexplode(F.coalesce(names, runs)).alias("pos", "symbol")).filter(
        "symbol is not null and symbol <> ''"
    )



def strategy_select(requested: DataFrame, name: str = "strategy") -> DataFrame:
    """Requested rules, each once; a name that is no rule is an error."""
    missing = [r[name] for r in unknown_strategies(requested, name).limit(5).collect()]
    if missing:
        raise ValueError(f"unknown rules: {', '.join(map(str, missing))}")
    return requested.filter(F.col(name).isin(*RULES)).select(name).distinct()


def unknown_strategies(requested: DataFrame, name: str = "strategy") -> DataFrame:
    return requested.filter(~F.col(name).isin(*RULES)).select(name).distinct()


def symbol_strategy_grid(symbols: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Every symbol with every rule; the catalogue is a literal list, so no join."""
    rules = F.array(*[F.lit(n) for n in (names or RULES)])
    return symbols.withColumn("strategy", F.explode(rules))


def symbol_clean(symbol: Column) -> Column:
    return F.upper(F.replace(symbol, F.lit("."), F.lit("-")))


def metric_name_clean(metric: Column) -> Column:
    return F.replace(F.replace(metric, F.lit("_%"), F.lit("")), F.lit("_"), F.lit(" "))
