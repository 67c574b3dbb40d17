"""Scoring result metrics against a target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.compare import clamp, safe_divide
from tickloom.operators.metrics import RESULT_COLUMNS
from tickloom.operators.selection import metric_name_clean

# Indicator, minimal, good and best target.
TARGETS = [
    ("TotalReturn", 0.0, 0.3, 0.6),
    ("rnorm100", 0.0, 0.01, 0.02),
    ("SharpeDaily", 0.01, 0.05, 0.1),
    ("SharpeAnnual", 0.25, 0.5, 1.0),
    ("Calmar", 0.3, 0.5, 1.0),
    ("MaxDrawdown", -1.0, -0.25, -0.15),
    ("TimeDD bars", -5000.0, -1000.0, -250.0),
    ("VWR", 1.0, 1.5, 2.0),
    ("SQN", 1.0, 2.0, 3.0),
    ("WinRate", 0.3, 0.5, 0.6),
    ("ProfitFactor", 1.0, 1.2, 2.0),
    ("Sortino", 1.0, 1.5, 2.0),
]
METRICS = [name for name in RESULT_COLUMNS.values() if name not in ("Symbol", "Strategy")]


def default_targets(spark: SparkSession) -> DataFrame:
    """From literals, so that Spark knows the size; a frame made from Python rows counts as too large to broadcast."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("indicator", "minimal", "good", "best"), row, strict=True)]) for row in TARGETS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def unpivot_metrics(table: DataFrame) -> DataFrame:
    """One row per symbol, rule and metric that has a numeric value."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in METRICS
    ])
    long = table.select("Symbol", "Strategy", F.inline(pairs))
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def with_targets(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics joined with their target by cleaned name; others are left out.

    No broadcast hint: a user's target table has no proven size, Spark
    broadcasts it when its statistics show it is small.
    """
    return metrics.withColumn("indicator", metric_name_clean(F.col("metric"))).join(targets, "indicator")


def unmatched_metrics(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    named = metrics.select("metric").distinct().withColumn("indicator", metric_name_clean(F.col("metric")))
    return named.join(targets, "indicator", "left_anti").select("metric")


def scale_position(value: Column, low: Column, high: Column) -> Column:
    return safe_divide(value - low, high - low)


def dial_angle(value: Column, low: Column, high: Column) -> Column:
    """Degrees on a half circle, 180 at the low end."""
    return 180 * (1 - scale_position(value, low, high))


def band_label(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "red").when(value > high, "green").otherwise("neutral")


_FINE = 20               # binary places kept apart below
_EXACT = 2.0**36         # the splitting is exact below this, and doubles have fewer than two decimals far above


def two_decimals(value: Column) -> Column:
    """``value`` with two decimals, rounded by its exact binary value, true halves to even.

    Java's formatting rounds the shortest decimal that stands for a double, so
    it takes 2.675 up although the double lies below.  Here a hundred times
    the value is split into a whole number of 2 ** -20 and an exact rest.
    """
    scaled = F.abs(value) * 2.0**_FINE
    whole = F.floor(scaled)
    rest = (scaled - whole) * 100
    cents = F.shiftright(whole * 100, _FINE)
    half = 2 ** (_FINE - 1) + F.shiftleft(cents, _FINE) - whole * 100
    cents = cents + F.when((rest > half) | ((rest == half) & (cents % 2 == 1)), 1).otherwise(0)
    written = F.concat(
        F.when(value < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
    return F.when(F.abs(value) < _EXACT, written).when(value.isNotNull(), F.format_string("%.2f", value))


def format_value(value: Column, as_percent: Column) -> Column:
    percent = value * 100
    sign = F.when(F.abs(percent) < float("inf"), "%").otherwise("")
    return F.when(as_percent, F.concat(two_decimals(percent), sign)).otherwise(two_decimals(value))


def score(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """Scale position, angle, band and label of every metric with a target."""
    value, low, high = F.col("value"), F.col("minimal"), F.col("best")
    drawn = clamp(value, low, high)
    return with_targets(metrics, targets).select(
        "Symbol", "Strategy", "metric", "value", "minimal", "good", "best",
        drawn.alias("drawn"),
        scale_position(drawn, low, high).alias("position"),
        dial_angle(drawn, low, high).alias("angle"),
        band_label(value, low, high).alias("band"),
        (value >= F.col("good")).alias("good_reached"),
        format_value(value, F.col("metric").contains("_%")).alias("label"),
    )
