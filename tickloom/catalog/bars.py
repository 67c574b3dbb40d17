"""Sources, sinks and selection (bars in, bars out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.catalog import sql as S
from tickloom.catalog.registry import bars_of, day, query
from tickloom.operators import selection as sel
from tickloom.operators.rules import RULES
from tickloom.session import new_folder
from tickloom.sources import files
from tickloom.sources.tables import hourly_bars, table

PRICES = ["open", "high", "low", "close", "volume"]
PRICE_LIST = ", ".join(PRICES)
DAILY = f"WITH {S.BARS} SELECT symbol, day, {PRICE_LIST} FROM bars"


@query("scan_bars_csv", DAILY)
def scan_bars_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "bars-csv")
    files.sink_bars(bars_of(spark, folder), path, F.col("symbol"), "csv")
    return files.scan_bars_csv(spark, path, series_column=True).select("symbol", day(), *PRICES)


HOURLY = """
hours AS (
  SELECT event_type AS symbol, DATE_TRUNC('hour', ts) AS hour, ARG_MIN(value, event_id) AS open, MAX(value) AS high,
         MIN(value) AS low, ARG_MAX(value, event_id) AS close, COUNT(*) AS volume
  FROM events GROUP BY 1, 2)"""
HOUR_TEXT = "STRFTIME(hour, '%Y-%m-%d %H:%M:%S')"


def hour_text(column: str = "ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("hour")


@query("scan_bars_intraday", f"WITH {HOURLY} SELECT symbol, 60 AS minutes, {HOUR_TEXT} AS hour, {PRICE_LIST} FROM hours")
def scan_bars_intraday(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "hour-csv")
    files.sink_bars(hourly_bars(table(spark, folder, "events")), path, F.concat("symbol", F.lit("_60m")), "csv")
    return files.scan_bars_csv(spark, path, series_column=True).select("symbol", "minutes", hour_text(), *PRICES)


@query("hourly_bars", f"WITH {HOURLY} SELECT symbol, {HOUR_TEXT} AS hour, {PRICE_LIST} FROM hours")
def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return hourly_bars(table(spark, folder, "events")).select("symbol", hour_text(), *PRICES)


def _flag_bars(spark: SparkSession, folder: str, flag: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").filter(F.col("l_returnflag") == flag)
    return lines.groupBy(
        F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").cast("timestamp").alias("ts")
    ).agg(F.max("l_extendedprice").alias("close"), F.sum("l_quantity").cast("long").alias("volume"))


_FLAG_SQL = """
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day, MAX(l_extendedprice) AS close,
         CAST(SUM(l_quantity) AS BIGINT) AS volume, {prio} AS prio FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1, 2"""
_FLAGS = "UNION ALL".join(_FLAG_SQL.format(prio=i, flag=f) for i, f in enumerate("ANR"))


@query("symbol_file_lookup", f"""
SELECT symbol, day, close, volume FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, day ORDER BY prio) AS rn FROM ({_FLAGS})) WHERE rn = 1""")
def symbol_file_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return files.first_source(*[_flag_bars(spark, folder, f) for f in "ANR"]).select("symbol", day(), "close", "volume")


def _status_bars(spark: SparkSession, folder: str, status: str) -> DataFrame:
    orders = table(spark, folder, "orders").filter(F.col("o_orderstatus") == status)
    return orders.groupBy(
        F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("date").cast("timestamp").alias("ts")
    ).agg(F.max("o_totalprice").alias("close"), F.lit(status).alias("source"))


_STATUS = """
st AS (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS day, MAX(o_totalprice) AS close,
              o_orderstatus AS source FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1, 2, 4)"""


@query("source_fallback", f"""
WITH {_STATUS} SELECT symbol, day, close, source FROM st
WHERE source = (SELECT MIN(b.source) FROM st b WHERE b.symbol = st.symbol)""")
def source_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return files.source_fallback(*[_status_bars(spark, folder, s) for s in "FOP"]).select("symbol", day(), "close", "source")


@query("bars_normalize", DAILY)
def bars_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = bars_of(spark, folder).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        *[F.col(c).cast("string").alias(c) for c in PRICES], F.col("close").cast("string").alias("adjusted_close"),
    )
    return files.bars_normalize(raw, "symbol").select("symbol", day(), *PRICES)


@query("column_title_case", f"""
WITH {S.BARS} SELECT symbol AS "Symbol", day AS "Day", {', '.join(f'{c} AS "{c.title()}"' for c in PRICES)} FROM bars""")
def column_title_case(spark: SparkSession, folder: str) -> DataFrame:
    bars = bars_of(spark, folder).select("symbol", day(), *PRICES)
    return files.title_columns(bars.toDF(*[f"{c}|X" for c in bars.columns]))


@query("response_filter", """
SELECT c_custkey AS response, 'timestamp,open,high' || CHR(10) || c_name AS text FROM customer WHERE c_custkey % 4 > 1""")
def response_filter(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("c_custkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('{"Information": "timestamp,open,high '), "c_name", F.lit('"}')))
        .when(kind == 1, F.concat(F.lit("no bars for "), "c_name"))
        .otherwise(F.concat(F.lit("timestamp,open,high\n"), "c_name"))
    )
    return files.bar_responses(table(spark, folder, "customer").select(F.col("c_custkey").alias("response"), text.alias("text")))


@query("sink_bars", DAILY)
def sink_bars(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "bars")
    files.sink_bars(bars_of(spark, folder), path, F.col("symbol"))
    back = spark.read.schema(files.PARQUET_BARS + ", series STRING").parquet(path)
    return back.select(
        F.col("series").alias("symbol"), F.to_date("Date").alias("day"),
        *[F.col(c.title()).alias(c) for c in PRICES],
    )


@query("scan_targets", """
SELECT p_brand AS indicator, ROUND(MIN(p_retailprice), 4) AS minimal, ROUND(AVG(p_retailprice), 4) AS good,
       ROUND(MAX(p_retailprice), 4) AS best FROM part GROUP BY 1""")
def scan_targets(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "targets")
    price = F.col("p_retailprice")
    wanted = table(spark, folder, "part").groupBy("p_brand").agg(
        *[F.round(f(price), 4).cast("string").alias(n) for f, n in ((F.min, "lo"), (F.avg, "mid"), (F.max, "hi"))]
    )
    lines = wanted.select(F.concat_ws(", ", F.concat(F.lit("  "), "p_brand"), "lo", "mid", "hi").alias("value"))
    lines.select(F.concat("value", F.lit("\n\n")).alias("value")).write.text(path)
    return files.scan_targets(spark, path, header=False)


@query("export_price_frame", f"""
WITH {S.BARS} SELECT symbol, day, {PRICE_LIST} FROM bars WHERE day BETWEEN DATE '1996-01-01' AND DATE '2000-01-01'""")
def export_price_frame(spark: SparkSession, folder: str) -> DataFrame:
    return files.export_price_frame(bars_of(spark, folder), "1996-01-01", "2000-01-01").select("symbol", day(), *PRICES)


# ---- selection --------------------------------------------------------------


@query("date_range_filter", f"""
WITH {S.BARS} SELECT symbol, day, {PRICE_LIST} FROM bars WHERE day BETWEEN DATE '1997-03-05' AND DATE '1999-06-30'""")
def date_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    return sel.date_range_filter(bars_of(spark, folder), "1997-03-05", "1999-06-30").select("symbol", day(), *PRICES)


@query("min_bars_filter", """
WITH parts AS (SELECT CAST(l_partkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day, CAST(SUM(l_quantity) AS BIGINT) AS volume
               FROM lineitem GROUP BY 1, 2)
SELECT symbol, day, volume FROM parts WHERE symbol IN (SELECT symbol FROM parts GROUP BY 1 HAVING COUNT(*) >= 30)""")
def min_bars_filter(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "lineitem").groupBy(
        F.col("l_partkey").cast("string").alias("symbol"), F.col("l_shipdate").cast("date").alias("day")
    ).agg(F.sum("l_quantity").cast("long").alias("volume"))
    return sel.min_bars_filter(bars, 30)


@query("empty_symbol_filter", """
SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM part WHERE p_partkey IN (
  SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity > 45)""")
def empty_symbol_filter(spark: SparkSession, folder: str) -> DataFrame:
    requested = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("symbol"))
    bars = table(spark, folder, "lineitem").filter("l_returnflag = 'A' and l_linestatus = 'F' and l_quantity > 45")
    return sel.empty_symbol_filter(requested, bars.select(F.col("l_partkey").cast("string").alias("symbol")))


@query("available_symbols", f"""
WITH {S.BARS}, ends AS (SELECT symbol, MAX(day) AS last_day FROM bars GROUP BY 1)
SELECT symbol, last_day FROM ends WHERE last_day >= (SELECT MAX(last_day) FROM ends) - INTERVAL 5 DAY""")
def available_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return sel.available_symbols(bars_of(spark, folder)).select("symbol", day("last_ts", "last_day"))


@query("symbol_dedupe_ordered", "SELECT CAST(user_id AS VARCHAR) AS symbol, MIN(event_id) AS first_pos FROM events GROUP BY 1")
def symbol_dedupe_ordered(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("symbol"), "event_id")
    return sel.symbol_dedupe_ordered(asked, "event_id")


@query("config_layout_merge", """
SELECT c_custkey, 0 AS pos, c_mktsegment AS symbol FROM customer
UNION ALL SELECT c_custkey, 1, c_name FROM customer WHERE c_custkey % 2 = 0""")
def config_layout_merge(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(
        F.col("c_custkey") % 2 == 0,
        F.format_string('{"symbols": ["%s", {"symbol": "%s"}, ""]}', "c_mktsegment", "c_name"),
    ).otherwise(F.format_string('{"runs": [{"symbol": "%s"}]}', "c_mktsegment"))
    return sel.config_symbols(table(spark, folder, "customer").select("c_custkey", text.alias("config")))


_CATALOGUE = ", ".join(f"'{n}'" for n in RULES)


@query("strategy_select", f"""
SELECT DISTINCT ([{_CATALOGUE}])[CAST(c_custkey % {len(RULES)} AS INT) + 1] AS strategy FROM customer""")
def strategy_select(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in RULES])
    asked = table(spark, folder, "customer").select(
        F.element_at(names, (F.col("c_custkey") % len(RULES) + 1).cast("int")).alias("strategy")
    )
    return sel.strategy_select(asked)


@query("symbol_strategy_grid", f"""
SELECT CAST(s_suppkey AS VARCHAR) AS symbol, UNNEST([{_CATALOGUE}]) AS strategy FROM supplier""")
def symbol_strategy_grid(spark: SparkSession, folder: str) -> DataFrame:
    return sel.symbol_strategy_grid(table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol")))


@query("symbol_clean", "SELECT p_partkey, UPPER(REPLACE(REPLACE(p_name, ' ', '.'), '.', '-')) AS symbol FROM part")
def symbol_clean(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "part").withColumn("_name", F.replace("p_name", F.lit(" "), F.lit(".")))
    return named.select("p_partkey", sel.symbol_clean(F.col("_name")).alias("symbol"))


@query("metric_name_clean", """
SELECT p_partkey, REPLACE(REPLACE(REPLACE(p_name, ' ', '_') || '_%', '_%', ''), '_', ' ') AS metric FROM part""")
def metric_name_clean(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "part").withColumn(
        "_name", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_%"))
    )
    return named.select("p_partkey", sel.metric_name_clean(F.col("_name")).alias("metric"))
