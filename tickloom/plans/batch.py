"""The configured run: what a user starts with a table of bars and a few settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.positions import Account
from tickloom.operators.rules import resolve
from tickloom.operators.selection import MIN_BARS, date_range_filter, min_bars_filter
from tickloom.operators.targets import score, unpivot_metrics
from tickloom.plans.backtest import backtest
from tickloom.plans.layout import key_sizes, lay_out


@dataclass(frozen=True)
class RunConfig:
    start: str | None = None
    end: str | None = None
    symbols: tuple[str, ...] = ()           # empty: all
    strategies: tuple[str, ...] = ()        # empty: all
    account: Account = field(default_factory=Account)
    min_bars: int = MIN_BARS

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> RunConfig:
        """Settings under their published names: start, end, capital, commission, slippage, strats, symbols."""
        defaults = Account(capital=10_000.0)
        names = [s if isinstance(s, str) else s.get("symbol") for s in settings.get("symbols") or ()]
        return cls(
            start=settings.get("start"), end=settings.get("end"),
            symbols=tuple(dict.fromkeys(n for n in names if n)),
            strategies=tuple(resolve(settings.get("strats"))),
            account=Account(
                capital=float(settings.get("capital", defaults.capital)),
                commission=float(settings.get("commission", defaults.commission)),
                slippage=float(settings.get("slippage", defaults.slippage)),
            ),
        )


def run_batch(bars: DataFrame, config: RunConfig) -> DataFrame:
    """The result table of a run: one row per symbol with enough bars and rule.

    The range and the symbols are filtered before the largest symbol decides
    the layout, so both reach the scan.
    """
    bars = date_range_filter(bars, config.start, config.end)
    if config.symbols:
        bars = bars.filter(F.col("symbol").isin(*config.symbols))
    sizes = key_sizes(bars)
    if config.min_bars > 1:
        bars = min_bars_filter(bars, config.min_bars)
    if sizes.whole:
        bars = bars.repartition(sizes.tasks(bars.sparkSession), "symbol")
    return backtest(*lay_out(bars, sizes.whole), config.strategies or None, config.account)


def run_scored(bars: DataFrame, config: RunConfig, targets: DataFrame) -> DataFrame:
    """Every metric of a run against its target."""
    return score(unpivot_metrics(run_batch(bars, config)), targets)
