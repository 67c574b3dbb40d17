"""Streaming queries over the event table, checked against their batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import sql as S
from tickloom.catalog.registry import query, rounded, rounded_sql
from tickloom.plans.layout import key_sizes, lay_out
from tickloom.session import new_folder
from tickloom.sources.tables import table
from tickloom.streaming import bars as st
from tickloom.streaming.indicators import indicator_states, run_stateful, stream_indicators
from tickloom.streaming.marks import stream_marks
from tickloom.streaming.positions import stream_positions

PRICES = ["open", "high", "low", "close", "volume"]
PRICE_LIST = ", ".join(PRICES)
_FORMAT = "yyyy-MM-dd HH:mm:ss"
_SUMMARY = """ARG_MIN(value, event_id) AS open, MAX(value) AS high, MIN(value) AS low,
  ARG_MAX(value, event_id) AS close, COUNT(*) AS volume"""
_MARK = "(SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)"


def _text(column: str) -> str:
    return f"STRFTIME({column}, '%Y-%m-%d %H:%M:%S')"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return st.stream_events(spark, folder, "events.parquet")


def _windows(bars: DataFrame) -> DataFrame:
    return bars.select(
        "symbol", F.date_format("window.start", _FORMAT).alias("start"), F.date_format("window.end", _FORMAT).alias("end"), *PRICES
    )


_TUMBLING = f"""
b AS (SELECT event_type AS symbol, DATE_TRUNC('hour', ts) AS start, {_SUMMARY} FROM events GROUP BY 1, 2),
closed AS (SELECT *, start + INTERVAL 1 HOUR AS stop FROM b WHERE start + INTERVAL 1 HOUR <= {_MARK})"""


@query("stream_ohlcv_bars", f"""
WITH {_TUMBLING} SELECT symbol, {_text('start')} AS start, {_text('stop')} AS "end", {PRICE_LIST} FROM closed""")
def stream_ohlcv_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(st.run_to_table(st.summarise(_events(spark, folder)), "hour-bars"))


@query("stream_dedupe", f"SELECT event_id, {_text('ts')} AS at, event_type, value FROM events")
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    delivered = _events(spark, folder).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    unique = st.dedupe(delivered).select("event_id", "ts", "event_type", "value")
    return st.run_to_table(unique, "unique").select(
        "event_id", F.date_format("ts", _FORMAT).alias("at"), "event_type", "value"
    )


@query("stream_sliding_features", f"""
WITH e AS (SELECT *, DATE_TRUNC('hour', ts) - k * INTERVAL 1 HOUR AS start FROM events, (SELECT UNNEST(RANGE(0, 6)) AS k)),
b AS (SELECT event_type AS symbol, start, start + INTERVAL 6 HOUR AS stop, {_SUMMARY} FROM e GROUP BY 1, 2, 3)
SELECT symbol, {_text('start')} AS start, {_text('stop')} AS "end", {PRICE_LIST} FROM b WHERE stop <= {_MARK}""")
def stream_sliding_features(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(st.run_to_table(st.summarise(_events(spark, folder), "6 hours", "1 hour"), "sliding"))


# Late rows: events of every seventh user arrive after all others.
_EARLY = "(SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 2 FROM events)"


@query("stream_late_data", f"""
WITH m AS (SELECT {_EARLY} AS mid, MAX(ts) - INTERVAL 1 HOUR AS mark FROM events),
ontime AS (SELECT e.* FROM events e, m WHERE NOT (user_id % 7 = 0 AND ts < mid)),
b AS (SELECT event_type AS symbol, DATE_TRUNC('hour', ts) AS start, {_SUMMARY} FROM ontime GROUP BY 1, 2)
SELECT symbol, {_text('start')} AS start, {_text('start + INTERVAL 1 HOUR')} AS "end", {PRICE_LIST}
FROM b, m WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_late_data(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    edges = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    middle = edges.select(F.col("lo") + (F.col("hi") - F.col("lo")) / 2).scalar()
    late = (F.col("user_id") % 7 == 0) & (F.col("ts") < middle)
    arrivals = [
        events.filter(~late & (F.col("ts") < middle)),
        events.filter(F.col("ts") >= middle),
        events.filter(late),
    ]
    inbox, out = new_folder(spark, "inbox"), new_folder(spark, "late-bars")
    for rows in arrivals:
        rows.write.mode("append").parquet(inbox)
        bars = st.summarise(st.stream_events(spark, inbox))
        st.run_to_folder(bars, "late-bars", out)
    return _windows(spark.read.schema(bars.schema).parquet(out))


@query("stream_positions", f"""
WITH {_TUMBLING}, signals AS (
  SELECT *, CASE WHEN close > open THEN 1 WHEN close < open THEN 0 END AS turn FROM closed),
held AS (
  SELECT symbol, start, close AS price, COALESCE(LAST_VALUE(turn IGNORE NULLS) OVER (
    PARTITION BY symbol ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS pos FROM signals)
SELECT symbol, {_text('start')} AS start, price, pos FROM held WHERE start <= (SELECT MAX(start) - INTERVAL 1 HOUR FROM closed)""")
def stream_positions_query(spark: SparkSession, folder: str) -> DataFrame:
    bars = st.summarise(_events(spark, folder)).select(
        "symbol", F.col("window.start").alias("ts"), F.col("close").alias("price"),
        (F.col("close") > F.col("open")).alias("entry"), (F.col("close") < F.col("open")).alias("exit"),
    )
    written = st.run_to_folder(bars, "signal-bars")
    positions = st.run_to_table(stream_positions(st.stream_table(spark, written, bars.schema)), "positions")
    return positions.select("symbol", F.date_format("ts", _FORMAT).alias("start"), "price", "pos")


_STREAMED = ("ema_fast", "ema_slow", "atr", "vwap")
_STREAMED_SQL = f"""
WITH RECURSIVE {_TUMBLING},
bars AS MATERIALIZED (SELECT symbol, start, open, high, low, close, volume, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY start) AS bar_no FROM closed),
{S.smoothed('ema12', 'ema26', 'atr14', plain_columns=('vwap',))}, {S.crosses('rec', 'crossed', {'x': 'ema12 - ema26'})},
named AS (SELECT symbol, start, close, ema12 AS ema_fast, ema26 AS ema_slow, atr14 AS atr, vwap, CAST(x AS INT) AS "cross" FROM crossed)
SELECT symbol, {_text('start')} AS start, close, "cross", {rounded_sql(*_STREAMED)} FROM named
WHERE start <= (SELECT MAX(start) - INTERVAL 1 HOUR FROM closed)"""


def _streamed(table_: DataFrame) -> DataFrame:
    return table_.select("symbol", F.date_format("ts", _FORMAT).alias("start"), "close", "cross", *rounded(*_STREAMED))


def _hour_bars(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    bars = st.summarise(_events(spark, folder)).select("symbol", F.col("window.start").alias("ts"), *PRICES)
    return st.run_to_folder(bars, "indicator-bars"), bars


@query("stream_indicators", _STREAMED_SQL)
def stream_indicators_query(spark: SparkSession, folder: str) -> DataFrame:
    """Exponential means, true range, volume-weighted price and crosses of hour bars, bar by bar on the stream."""
    written, bars = _hour_bars(spark, folder)
    return _streamed(run_stateful(stream_indicators(st.stream_table(spark, written, bars.schema)), "indicators"))


@query("stream_indicators_resumed", f"{_STREAMED_SQL} AND start >= {_EARLY}")
def stream_indicators_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The first half as a table, whose states the stream of the second half starts from."""
    written, bars = _hour_bars(spark, folder)
    edges = table(spark, folder, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    middle = edges.select(F.col("lo") + (F.col("hi") - F.col("lo")) / 2).scalar()
    old = spark.read.schema(bars.schema).parquet(written).filter(F.col("ts") < middle)
    states = indicator_states(*lay_out(old, key_sizes(old).whole))
    later = new_folder(spark, "later-bars")
    spark.read.schema(bars.schema).parquet(written).filter(F.col("ts") >= middle).write.parquet(later)
    return _streamed(run_stateful(stream_indicators(st.stream_table(spark, later, bars.schema), states), "indicators"))


@query("stream_marks", f"""
WITH {_TUMBLING}, marks AS (
  SELECT event_type AS symbol, DATE_TRUNC('hour', ts) AS start, MAX(event_id % 11 = 0) AS bought, MAX(event_id % 13 = 0) AS sold FROM events GROUP BY 1, 2)
SELECT symbol, {_text('start')} AS start, close, CASE WHEN bought THEN close END AS buy_mark, CASE WHEN sold THEN close END AS sell_mark
FROM closed JOIN marks USING (symbol, start)
WHERE start + INTERVAL 1 HOUR <= (SELECT LEAST(MAX(start), (SELECT MAX(ts) FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0)) - INTERVAL 1 HOUR FROM closed)""")
def stream_marks_query(spark: SparkSession, folder: str) -> DataFrame:
    """Bars and events as two streams; some events count as buys and sells."""
    written, bars = _hour_bars(spark, folder)
    kind = F.when(F.col("event_id") % 11 == 0, F.array_append(F.array(F.lit("buy")), F.when(F.col("event_id") % 13 == 0, "sell")))
    kind = F.coalesce(kind, F.when(F.col("event_id") % 13 == 0, F.array(F.lit("sell"))))
    events = _events(spark, folder).select(F.col("event_type").alias("symbol"), F.col("ts").alias("at"), F.explode(kind).alias("kind"))
    marks = stream_marks(st.stream_table(spark, written, bars.schema), events.filter("kind is not null").withWatermark("at", "1 hour"))
    table_ = st.run_to_table(marks, "marks")
    return table_.select("symbol", F.date_format("ts", _FORMAT).alias("start"), "close", "buy_mark", "sell_mark")
