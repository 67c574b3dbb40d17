"""Bars derived from order-line and event tables.

``daily_bars`` walks one price path per supplier in whole cents, so that every
engine gets the same doubles; ``hourly_bars`` summarises events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.plans.layout import KeySizes, key_sizes

CENTS = 100.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def supplier_days(lines: DataFrame, sizes: KeySizes) -> DataFrame:
    """Value and quantity per supplier and day.

    With few lines per supplier and day a map-side combine saves nothing, so
    lines that fit are shuffled by supplier once and stay there for all windows.
    """
    lines = lines.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("date").cast("timestamp").alias("ts"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        "l_quantity",
    )
    if sizes.whole:
        lines = lines.repartition(sizes.tasks(lines.sparkSession), "symbol")
    return lines.groupBy("symbol", "ts").agg(
        F.sum("cents").alias("v"), F.sum("l_quantity").cast("long").alias("volume")
    )


def daily_bars(lines: DataFrame, sizes: KeySizes) -> DataFrame:
    """symbol, ts, open, high, low, close, volume."""
    days = supplier_days(lines, sizes).withColumn("step", F.col("v") % 401 - 200)
    if sizes.whole:
        along = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        walked = days.withColumn("walk", F.sum("step").over(along))
    else:
        walked = _walk_by_month(days)
    close = F.greatest(F.lit(100), 10000 + F.col("walk"))
    before = F.greatest(F.lit(100), 10000 + F.col("walk") - F.col("step"))
    cents = walked.select(
        "symbol", "ts", "v", "volume", close.alias("c"),
        F.greatest(F.lit(100), before + F.floor(F.col("v") / 7) % 101 - 50).alias("o"),
    )
    return cents.select(
        "symbol", "ts",
        (F.col("o") / CENTS).alias("open"),
        ((F.greatest("o", "c") + F.floor(F.col("v") / 11) % 50) / CENTS).alias("high"),
        ((F.least("o", "c") - F.floor(F.col("v") / 13) % 50) / CENTS).alias("low"),
        (F.col("c") / CENTS).alias("close"),
        "volume",
    )


def _walk_by_month(days: DataFrame) -> DataFrame:
    """Running sum of the steps: inside a month, plus the months before."""
    days = days.withColumn("month", F.date_trunc("month", "ts"))
    along = Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        days.groupBy("symbol", "month").agg(F.sum("step").alias("_steps"))
        .select("symbol", "month", F.coalesce(F.sum("_steps").over(along), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("symbol", "month").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return (
        days.withColumn("_walk", F.sum("step").over(inside))
        .join(starts, ["symbol", "month"])
        .withColumn("walk", F.col("_start") + F.col("_walk"))
        .drop("month", "_start", "_walk")
    )


def supplier_sizes(lines: DataFrame) -> KeySizes:
    """Lines per supplier, an upper bound of its bars, from one column of the scan."""
    return key_sizes(lines, ["l_suppkey"])


def hourly_bars(events: DataFrame, *by: str) -> DataFrame:
    """One bar per event type and hour; open and close in order of time and id."""
    order = F.struct("ts", "event_id")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return events.groupBy(F.col("event_type").alias("symbol"), *by, hour.alias("hour")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    ).withColumnRenamed("hour", "ts")
