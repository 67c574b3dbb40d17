"""The batch run: bars -> indicators -> rules -> positions -> equity -> results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tickloom.operators.indicators import with_rule_indicators
from tickloom.operators.metrics import result_table, results
from tickloom.operators.positions import ADDED, MOST_BESIDE, Account, with_equity, with_fills, with_position, with_returns
from tickloom.operators.rules import RULES, flags_beside, resolve, series_as_rows, stack_rules, tags_of
from tickloom.plans.layout import Layout, spread_over

KEPT = ("symbol", "ts", "bar_no", "close", "buy_fill", "sell_fill", "next_ts", "next_close")


def _with_needs(df: DataFrame, lay: Layout, names: list[str], account: Account, delay: int, keep: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Bars with fills and all that the rules read, and the columns that go on."""
    needed = {column for name in names for column in RULES[name]().needs} - set(df.columns)
    kept = [*KEPT, *keep, *(["chunk", "own"] if lay.chunked else [])]
    return with_rule_indicators(with_fills(df, lay, account, delay), lay, needed, alone=True), kept


def signals(df: DataFrame, lay: Layout, strategies: str | Iterable[str] | None = None,
            account: Account = Account(), delay: int = 1, keep: Iterable[str] = ()) -> tuple[DataFrame, Layout]:
    """Entry and exit of every rule on every bar, with the prices an order would get."""
    names = resolve(strategies)
    df, kept = _with_needs(df, lay, names, account, delay, keep)
    stacked = stack_rules(df, names, kept)
    if lay.spread and len(names) > 1:
        stacked = spread_over(stacked, *lay.keys, "strategy")
    return stacked, lay.per("strategy")


def run(df: DataFrame, lay: Layout, strategies: str | Iterable[str] | None = None,
        account: Account = Account(), delay: int = 1, keep: Iterable[str] = ()) -> tuple[DataFrame, Layout]:
    """Bars with position, equity and returns per symbol and rule.

    The rules of a bar stand beside each other in one row until their returns
    are known, so the bars are neither copied, sorted nor written once per
    rule.  Where few symbols are to be dealt out by rule, rules are rows.
    """
    names = resolve(strategies)
    if len(names) == 1 or len(names) > MOST_BESIDE or lay.spread:
        df, lay = signals(df, lay, names, account, delay, keep)
        df = with_equity(with_position(df, lay, account), lay, account)
        return with_returns(df, lay, account), lay
    df, kept = _with_needs(df, lay, names, account, delay, keep)
    df = flags_beside(df, names, [*kept, "block"])
    tags, sorted_ = tags_of(names), lay.by_block()      # as the smoothings left the bars
    df = with_equity(with_position(df, sorted_, account, tags), sorted_, account, tags)
    df = with_returns(df, sorted_, account, tags).drop("block")
    return series_as_rows(df, ADDED, {"strategy": names}), lay.per("strategy")


def backtest(df: DataFrame, lay: Layout, strategies: str | Iterable[str] | None = None,
             account: Account = Account()) -> DataFrame:
    return result_table(results(*run(df, lay, strategies, account), account))
