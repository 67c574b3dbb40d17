"""Result metrics per symbol and rule, and the result table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.compare import real_deviation, safe_divide
from tickloom.operators.positions import Account, trade_terms
from tickloom.plans.layout import Layout

YEAR = 252
DAILY_RATE = 1.01 ** (1 / YEAR) - 1   # risk-free rate of 1 % a year per bar
VWR_SIGMA_MAX = 0.20
LOSS = -1e-12                          # returns above this are float noise, not losses

# Names and order of the result table.
RESULT_COLUMNS = {
    "symbol": "Symbol",
    "strategy": "Strategy",
    "total_return": "TotalReturn_%",
    "annual_return": "rnorm100_%",
    "sharpe_daily": "SharpeDaily",
    "sharpe_annual": "SharpeAnnual",
    "calmar": "Calmar",
    "max_drawdown": "MaxDrawdown_%",
    "time_dd": "TimeDD_bars",
    "vwr": "VWR",
    "sqn": "SQN",
    "win_rate": "WinRate_%",
    "profit_factor": "ProfitFactor",
    "avg_trade_pl": "AvgTradePL",
    "trades_total": "trades_total",
    "sortino": "Sortino",
}


def _ratio(a: Column, b: Column) -> Column:
    return safe_divide(a, b)


def sharpe(ret: str = "ret", rate: float = DAILY_RATE) -> Column:
    """NULL for an account that never moves, however its parts were added up."""
    excess = F.col(ret) - rate
    return _ratio(F.avg(excess), real_deviation(F.stddev_pop(excess), F.avg(F.abs(excess))))


def sortino(ret: str = "ret", per_year: int = YEAR) -> Column:
    """+Infinity without losses; NULL when a single loss has no deviation."""
    loss = F.when(F.col(ret) < LOSS, F.col(ret))
    return (
        F.when(F.count(ret) == 0, None)
        .when(F.count(loss) == 0, F.lit(float("inf")))
        .when(F.count(loss) > 1, _ratio(F.avg(ret), real_deviation(F.stddev_samp(loss), F.avg(F.abs(loss)))) * math.sqrt(per_year))
    )


def trend_gap(account: Account = Account()) -> Column:
    """Distance of the account from the steady growth that ends at the same value."""
    rate = F.log(F.col("end_equity") / account.capital) / F.col("bars")
    return F.col("equity") / (account.capital * F.exp(rate * F.col("bar_no"))) - 1


def bar_metrics(account: Account) -> dict[str, Column]:
    total = F.log(F.max_by("equity", "bar_no") / account.capital)
    return {
        "bars": F.count(F.lit(1)),
        "total_return": total,
        "annual_return": F.exp(total * YEAR / F.count(F.lit(1))) - 1,
        "sharpe_daily": sharpe(),
        "max_drawdown": F.lit(0.0) - F.max("drawdown"),
        "time_dd": -F.max("underwater"),
        "sortino": sortino(),
    }


def trade_metrics() -> dict[str, Column]:
    """Over bars that carry ``opens``, ``closes`` and the net result of the closed trade."""
    net = F.col("pnl_net")
    won = F.coalesce(net >= 0, F.lit(False))
    lost_sum = F.sum(F.when(net < 0, net))
    total = F.count_if(F.col("opens"))
    return {
        "trades_total": total,
        "win_rate": _ratio(F.count_if(won), total),
        "profit_factor": _ratio(F.coalesce(F.sum(F.when(won, net)), F.lit(0.0)), F.abs(lost_sum)),
        "avg_trade_pl": F.avg(net),
        "sqn": _ratio(F.sqrt(F.count(net)) * F.avg(net), real_deviation(F.stddev_pop(net), F.avg(F.abs(net)))),
    }


def results(df: DataFrame, lay: Layout, account: Account = Account()) -> DataFrame:
    """One row per key from bars with equity and returns: a single aggregation
    in the whole layout, map-side combined in the chunked one."""
    df = df.withColumns({**trade_terms(account), "_gap": trend_gap(account)})
    table = df.groupBy(*lay.keys).agg(
        *[c.alias(n) for n, c in {**bar_metrics(account), **trade_metrics()}.items()],
        F.stddev_samp("_gap").alias("_gap"),
    )
    return table.withColumns({
        "sharpe_annual": F.col("sharpe_daily") * math.sqrt(YEAR),
        "calmar": _ratio(F.col("annual_return"), F.abs("max_drawdown")),
        "vwr": 100 * F.col("annual_return") * (1 - F.pow(F.col("_gap") / VWR_SIGMA_MAX, F.lit(2.0))),
    }).drop("_gap")


def result_table(table: DataFrame) -> DataFrame:
    """The sixteen published columns under their published names."""
    return table.select(*[F.col(c).alias(name) for c, name in RESULT_COLUMNS.items()])
