"""Bars that are corrected after delivery: every version is kept with the time it became known.

The version zone only grows; the current zone is what it says now.  A delivery
writes the versions that are news, and rewrites the months it touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.risk import split_valid
from tickloom.session import settle

VALUES = ("open", "high", "low", "close", "volume")
KEY = ("symbol", "ts")
REJECTED = (*KEY, *VALUES, "reason")


def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, empty before the first delivery."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.listStatus(place):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def _differs(names: Sequence[str], a: str, b: str) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return ~same


def latest(versions: DataFrame) -> DataFrame:
    """The last version of every bar; of two that became known at once the one with the larger values."""
    row = F.struct(*VALUES)
    best = F.max(F.struct("known_at", row.alias("row"))).alias("best")
    return versions.groupBy(*KEY).agg(best).select(*KEY, "best.row.*", "best.known_at")


def as_known_at(versions: DataFrame, moment: Column) -> DataFrame:
    """The bars as they were known at ``moment``, without anything that came later."""
    return latest(versions.filter(F.col("known_at") <= moment))


def deliver(raw: DataFrame, versions: str, current: str, quarantine: str, known_at: Column) -> None:
    """Takes in one delivery of raw bars (symbol, ts, prices, volume).

    Clean bars that say something new become versions; what is delivered again
    unchanged leaves no trace, so a delivery may be repeated.  Rejected rows go
    to the quarantine once, however often they come.  Only the months of the
    delivery are read from the zones and only those with news are rewritten.
    """
    spark = raw.sparkSession
    clean, rejected = split_valid(raw.select(*KEY, *VALUES))
    clean = settle(clean.withColumns({"known_at": known_at.cast("timestamp"), "month": _month(F.col("ts"))}))
    months = clean.select("month").distinct()
    known = _read(spark, versions, clean).join(months, "month", "left_semi")
    news = settle(
        clean.alias("new").join(latest(known).alias("old"), list(KEY), "left")
        .filter(F.col("old.known_at").isNull() | _differs(VALUES, "new", "old")).select("new.*")
    )
    news.sortWithinPartitions("month", *KEY).write.mode("append").partitionBy("month").parquet(versions)
    touched = news.select("month").distinct()
    now = latest(spark.read.schema(clean.schema).parquet(versions).join(touched, "month", "left_semi"))
    now.withColumn("month", _month(F.col("ts"))).sortWithinPartitions("month", *KEY).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(current)
    rejected = settle(rejected.select(*REJECTED).distinct().withColumn("month", _month(F.col("ts"))))
    seen = _read(spark, quarantine, rejected)
    mark = F.xxhash64(*[F.col(c).cast("string") for c in REJECTED]).alias("_mark")
    same = F.lit(True)
    for c in REJECTED:
        same = same & F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
    fresh = rejected.select("*", mark).alias("new").join(
        seen.select("*", mark).alias("old"), (F.col("new._mark") == F.col("old._mark")) & same, "left_anti"
    )
    fresh.drop("_mark").write.mode("append").partitionBy("month").parquet(quarantine)
