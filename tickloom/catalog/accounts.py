"""Positions, trades, equity, metrics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import sql as S
from tickloom.catalog.registry import bars_of, day, laid, laid_in_chunks, query, rounded, rounded_sql
from tickloom.functions.compare import clamp
from tickloom.operators import positions as pos
from tickloom.operators import targets as tg
from tickloom.operators.metrics import RESULT_COLUMNS, results
from tickloom.operators.positions import Account
from tickloom.operators.rules import RULES
from tickloom.plans.backtest import backtest, run, signals
from tickloom.plans.batch import RunConfig, run_batch
from tickloom.plans.layout import Layout, own_rows
from tickloom.session import new_folder
from tickloom.sources.files import sink_results

BUSY = "DonchianTurtle"     # trades often, so every account operator has work
CHUNK_BACK = 1_700          # look-back of the rule catalogue; a shorter halo is refused
FLAGS = f"WITH RECURSIVE {S.rule_flags(BUSY)}"
ACCOUNT = f"{FLAGS}, {S.account()}"
RETURNS = f"{ACCOUNT}, {S.returns()}"
RESULTS = f"{RETURNS}, {S.results()}"
ALL_RESULTS = f"WITH RECURSIVE {S.rule_flags(*RULES)}, {S.account()}, {S.returns()}, {S.results()}"
BY = "PARTITION BY symbol ORDER BY bar_no"


def _signals(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    return signals(*laid(spark, folder), BUSY)


def _positions(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    df, lay = _signals(spark, folder)
    return pos.with_position(df, lay), lay


def _equity(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    df, lay = _positions(spark, folder)
    return pos.with_equity(df, lay), lay


def _run(spark: SparkSession, folder: str) -> tuple[DataFrame, Layout]:
    return run(*laid(spark, folder), BUSY)


@query("position_state", f"{ACCOUNT} SELECT symbol, day, pos FROM acct")
def position_state(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder)[0].select("symbol", day(), "pos")


_FILLS = f"""
fills AS (SELECT *, LEAD(open) OVER ({BY}) AS n_open, LEAD(high) OVER ({BY}) AS n_high, LEAD(low) OVER ({BY}) AS n_low FROM flags),
priced AS (SELECT *, CASE WHEN n_open IS NOT NULL THEN LEAST(n_high, n_open * 1.0005) END AS buy_fill,
                  CASE WHEN n_open IS NOT NULL THEN GREATEST(n_low, n_open * 0.9995) END AS sell_fill FROM fills)"""


@query("fill_price", f"{FLAGS}, {_FILLS} SELECT symbol, day, {rounded_sql('buy_fill', 'sell_fill')} FROM priced")
def fill_price(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = laid(spark, folder)
    return own_rows(pos.with_fills(df, lay), lay).select("symbol", day(), *rounded("buy_fill", "sell_fill"))


@query("position_size", f"""{ACCOUNT} SELECT symbol, day, {rounded_sql('size')} FROM acct WHERE act = 1""")
def position_size(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = _equity(spark, folder)
    entered = df.filter("opens").withColumn(
        "size", Account().capital * F.col("growth") * Account().stake / F.col("close")
    )
    return entered.select("symbol", day("next_ts"), *rounded("size"))


@query("affordability_filter", f"""
{FLAGS}, {_FILLS} SELECT symbol, day, ROUND(0.95 * buy_fill * 1.001 / close, 6) AS cost FROM priced
WHERE entry AND 0.95 * buy_fill * 1.001 / close <= 1""")
def affordability_filter(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = _signals(spark, folder)
    cost = pos.order_cost(Account())
    return own_rows(df, lay).filter(F.col("entry") & (cost <= 1)).select("symbol", day(), F.round(cost, 6).alias("cost"))


@query("commission", f"{ACCOUNT} SELECT symbol, day, ROUND(traded * 0.001, 6) AS fee FROM acct WHERE act <> 0")
def commission(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = _equity(spark, folder)
    cash = Account().capital * F.col("growth")
    traded = F.when(F.col("opens"), cash * Account().stake / F.col("close") * F.col("buy_fill")).otherwise(
        cash * F.col("unit") * F.col("sell_fill")
    )
    return df.filter("opens or closes").select(
        "symbol", day("next_ts"), F.round(traded * Account().commission, 6).alias("fee")
    )


_MARKS = "marks AS (SELECT symbol, strategy, CASE act WHEN 1 THEN 'buy' ELSE 'sell' END AS kind, day, close AS price FROM acct WHERE act <> 0)"


@query("entry_exit_events", f"{ACCOUNT}, {_MARKS} SELECT * FROM marks")
def entry_exit_events(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = _positions(spark, folder)
    return pos.marks(df, lay).select("symbol", "strategy", "kind", day(), "price")


_TRADE_VALUES = ("entry_price", "exit_price", "size", "pnl_gross", "pnl_net")


@query("trade_pairing", f"""
{ACCOUNT}, sized AS (SELECT *, LAG(size) OVER ({BY}) AS held FROM acct),
last_bars AS (SELECT symbol, MAX(bar_no) AS bar_no FROM acct GROUP BY 1),
t AS (
  SELECT symbol, entry_day, day AS exit_day, bar_no - entry_bar AS bars_held, FALSE AS is_open,
         entry_price, exit_price, held AS size, pnl_gross, pnl_net FROM sized WHERE act = -1
  UNION ALL
  SELECT symbol, entry_day, NULL, NULL, TRUE, entry_price, NULL, size, NULL, NULL
  FROM sized JOIN last_bars USING (symbol, bar_no) WHERE pos = 1)
SELECT symbol, entry_day, exit_day, bars_held, is_open, {rounded_sql(*_TRADE_VALUES)} FROM t""")
def trade_pairing(spark: SparkSession, folder: str) -> DataFrame:
    return pos.trades(*_equity(spark, folder)).select(
        "symbol", day("entry_ts", "entry_day"), day("exit_ts", "exit_day"), "bars_held", "is_open", *rounded(*_TRADE_VALUES)
    )


@query("equity_curve", f"{ACCOUNT} SELECT symbol, day, {rounded_sql('equity')} FROM acct")
def equity_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _equity(spark, folder)[0].select("symbol", day(), *rounded("equity"))


@query("bar_returns", f"{RETURNS} SELECT symbol, day, {rounded_sql('ret', digits=8)} FROM rets")
def bar_returns(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder)[0].select("symbol", day(), *rounded("ret", digits=8))


@query("drawdown_curve", f"{RETURNS} SELECT symbol, day, {rounded_sql('drawdown', digits=8)} FROM rets")
def drawdown_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder)[0].select("symbol", day(), *rounded("drawdown", digits=8))


@query("drawdown_runs", f"""
{RETURNS}, marked AS (SELECT *, SUM(CASE WHEN drawdown <= 1e-9 THEN 1 ELSE 0 END) OVER ({BY}) AS run FROM rets)
SELECT symbol, MIN(day) AS start_day, MAX(day) AS end_day, COUNT(*) AS bars FROM marked WHERE drawdown > 1e-9 GROUP BY symbol, run""")
def drawdown_runs(spark: SparkSession, folder: str) -> DataFrame:
    return pos.underwater_runs(*_run(spark, folder)).select("symbol", day("start_ts", "start_day"), day("end_ts", "end_day"), "bars")


@query("event_mark_join", f"""
{ACCOUNT}, {_MARKS} SELECT a.symbol, a.day, b.price AS buy_mark, s.price AS sell_mark FROM acct a
LEFT JOIN marks b ON b.symbol = a.symbol AND b.day = a.day AND b.kind = 'buy'
LEFT JOIN marks s ON s.symbol = a.symbol AND s.day = a.day AND s.kind = 'sell'""")
def event_mark_join(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = _positions(spark, folder)
    return pos.mark_bars(df, pos.marks(df, lay), list(lay.keys)).select("symbol", day(), "buy_mark", "sell_mark")


# ---- the same over keys too large for one task ------------------------------


@query("chunked_position_state", f"{ACCOUNT} SELECT symbol, day, pos FROM acct")
def chunked_position_state(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = signals(*laid_in_chunks(spark, folder, CHUNK_BACK), BUSY)
    return pos.with_position(df, lay).select("symbol", day(), "pos")


@query("chunked_equity_curve", f"{ACCOUNT} SELECT symbol, day, {rounded_sql('equity')} FROM acct")
def chunked_equity_curve(spark: SparkSession, folder: str) -> DataFrame:
    df, lay = signals(*laid_in_chunks(spark, folder, CHUNK_BACK), BUSY)
    return pos.with_equity(pos.with_position(df, lay), lay).select("symbol", day(), *rounded("equity"))


# ---- metrics ----------------------------------------------------------------

_WHOLE = ("time_dd", "trades_total")


def _metric(name: str, column: str) -> None:
    value = column if column in _WHOLE else rounded_sql(column)

    @query(name, f"{RESULTS} SELECT symbol, strategy, {value} FROM res")
    def metric(spark: SparkSession, folder: str) -> DataFrame:
        table = results(*_run(spark, folder))
        return table.select("symbol", "strategy", *([column] if column in _WHOLE else rounded(column)))


for _column in [c for c in RESULT_COLUMNS if c not in ("symbol", "strategy")]:
    _metric(f"metric_{_column}", _column)

_PUBLISHED = ", ".join(
    f'{c if c in ("symbol", "strategy", *_WHOLE) else rounded_sql(c).split(" AS ")[0]} AS "{name}"' for c, name in RESULT_COLUMNS.items()
)
_FLOATS = [name for c, name in RESULT_COLUMNS.items() if c not in ("symbol", "strategy", *_WHOLE)]


def _published(table: DataFrame) -> DataFrame:
    return table.select(*[rounded(c)[0] if c in _FLOATS else F.col(c) for c in table.columns])


@query("results_table", f"""
WITH RECURSIVE {S.rule_flags(*RULES)}, {S.account()}, {S.returns()}, {S.results()} SELECT {_PUBLISHED} FROM res""")
def results_table(spark: SparkSession, folder: str) -> DataFrame:
    return _published(backtest(*laid(spark, folder)))


@query("chunked_results_table", f"{ALL_RESULTS} SELECT {_PUBLISHED} FROM res")
def chunked_results_table(spark: SparkSession, folder: str) -> DataFrame:
    return _published(backtest(*laid_in_chunks(spark, folder, CHUNK_BACK)))


@query("golden_cross_backtest", f"""
WITH RECURSIVE {S.rule_flags('GoldenCross')}, {S.account()}, {S.returns()}, {S.results()} SELECT {_PUBLISHED} FROM res""")
def golden_cross_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return _published(backtest(*laid(spark, folder), "GoldenCross"))


@query("sink_results", f"{ALL_RESULTS} SELECT {_PUBLISHED} FROM res")
def sink_results_query(spark: SparkSession, folder: str) -> DataFrame:
    table = backtest(*laid(spark, folder))
    one, two = new_folder(spark, "results"), new_folder(spark, "results")
    sink_results(table, one, two)
    return _published(spark.read.schema(table.schema).csv(two, header=True))


SETTINGS = {
    "start": "1996-01-01", "end": "2000-01-01", "capital": 1000, "commission": 0.001, "slippage": 0.0005,
    "strats": ["GoldenCross", "Rsi2", "Rsi2"],
}
_RANGE = """all_bars AS MATERIALIZED ({bars}),
bars AS MATERIALIZED (
  SELECT * REPLACE (ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY day) AS bar_no) FROM all_bars
  WHERE day BETWEEN DATE '1996-01-01' AND DATE '2000-01-01' QUALIFY COUNT(*) OVER (PARTITION BY symbol) >= 252)"""
_BEFORE_BARS, _BARS_BODY = S.BARS.split("bars AS MATERIALIZED (")


@query("configured_run", f"""
WITH RECURSIVE {_BEFORE_BARS}{_RANGE.format(bars=_BARS_BODY.rstrip().removesuffix(')'))}
{S.rule_flags('GoldenCross', 'Rsi2').removeprefix(S.BARS)}, {S.account()}, {S.returns()}, {S.results()} SELECT {_PUBLISHED} FROM res""")
def configured_run(spark: SparkSession, folder: str) -> DataFrame:
    return _published(run_batch(bars_of(spark, folder), RunConfig.from_mapping(SETTINGS)))


# ---- scores -----------------------------------------------------------------

_LONG = f"""
{ALL_RESULTS}, long AS (
{' UNION ALL '.join(f"SELECT symbol AS Symbol, strategy AS Strategy, '{name}' AS metric, CAST({c} AS DOUBLE) AS value FROM res" for c, name in RESULT_COLUMNS.items() if c not in ('symbol', 'strategy'))}),
numeric AS (SELECT * FROM long WHERE value IS NOT NULL),
targets AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in tg.TARGETS)}) t(indicator, minimal, good, best)),
scored AS (
  SELECT *, GREATEST(LEAST(value, best), minimal) AS drawn FROM numeric
  JOIN targets ON indicator = REPLACE(REPLACE(metric, '_%', ''), '_', ' '))"""
_NAMED = "Symbol, Strategy, metric"


def _long(spark: SparkSession, folder: str) -> DataFrame:
    return tg.unpivot_metrics(backtest(*laid(spark, folder)))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return tg.with_targets(_long(spark, folder), tg.default_targets(spark))


@query("unpivot_metrics", f"{_LONG} SELECT {_NAMED}, {rounded_sql('value')} FROM numeric")
def unpivot_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _long(spark, folder).select("Symbol", "Strategy", "metric", *rounded("value"))


@query("target_lookup_join", f"{_LONG} SELECT {_NAMED}, minimal, good, best, {rounded_sql('value')} FROM scored")
def target_lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("Symbol", "Strategy", "metric", "minimal", "good", "best", *rounded("value"))


@query("unmatched_metrics", f"""{_LONG} SELECT DISTINCT metric FROM numeric
WHERE REPLACE(REPLACE(metric, '_%', ''), '_', ' ') NOT IN (SELECT indicator FROM targets)""")
def unmatched_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return tg.unmatched_metrics(_long(spark, folder), tg.default_targets(spark))


@query("clamp", f"{_LONG} SELECT {_NAMED}, {rounded_sql('drawn')} FROM scored")
def clamp_query(spark: SparkSession, folder: str) -> DataFrame:
    drawn = _scored(spark, folder).withColumn("drawn", clamp(F.col("value"), F.col("minimal"), F.col("best")))
    return drawn.select("Symbol", "Strategy", "metric", *rounded("drawn"))


@query("scale_position", f"""{_LONG}, placed AS (
  SELECT *, (drawn - minimal) / (best - minimal) AS position, 180 * (1 - (drawn - minimal) / (best - minimal)) AS angle FROM scored)
SELECT {_NAMED}, {rounded_sql('position')}, {rounded_sql('angle', digits=4)} FROM placed""")
def scale_position(spark: SparkSession, folder: str) -> DataFrame:
    return tg.score(_long(spark, folder), tg.default_targets(spark)).select(
        "Symbol", "Strategy", "metric", *rounded("position"), *rounded("angle", digits=4)
    )


@query("band_label", f"""{_LONG} SELECT {_NAMED}, value >= good AS good_reached,
  CASE WHEN value < minimal THEN 'red' WHEN value > best THEN 'green' ELSE 'neutral' END AS band FROM scored""")
def band_label(spark: SparkSession, folder: str) -> DataFrame:
    return tg.score(_long(spark, folder), tg.default_targets(spark)).select(
        "Symbol", "Strategy", "metric", "good_reached", "band"
    )


@query("format_value", f"""{_LONG} SELECT {_NAMED}, CASE WHEN isinf(value) THEN 'Infinity'
  WHEN CONTAINS(metric, '_%') THEN PRINTF('%.2f%%', value * 100) ELSE PRINTF('%.2f', value) END AS label FROM scored""")
def format_value(spark: SparkSession, folder: str) -> DataFrame:
    return tg.score(_long(spark, folder), tg.default_targets(spark)).select("Symbol", "Strategy", "metric", "label")
