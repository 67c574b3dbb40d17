"""Raw zone -> processed zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.risk import split_valid


def raw_to_processed(raw: DataFrame, processed: str, quarantine: str, batch: str) -> None:
    """Judges a delivery of raw bars and writes clean and rejected rows to their zones (Parquet, a folder per batch).

    A batch owns its folder in both zones and replaces it, so a delivery that
    comes twice, or a run that broke off between the two writes, leaves the
    zones as one run does.  Bars that another batch has already brought are
    left out; only the days of this delivery are looked up.  A rejected row
    lies in the quarantine once, whichever batches bring it.
    """
    spark = raw.sparkSession
    clean, rejected = split_valid(raw)
    clean = clean.withColumn("day", F.to_date("ts"))
    known = _others(spark, processed, batch)
    if known is not None:
        span = clean.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
        known = known.filter(F.col("day").between(span["low"], span["high"])).select("symbol", "ts")
        clean = clean.join(known, ["symbol", "ts"], "left_anti")
    clean.sortWithinPartitions("day", "symbol").write.mode("overwrite").parquet(_folder(processed, batch))
    seen = _others(spark, quarantine, batch)      # what another batch brought is there already
    rejected = rejected.distinct() if seen is None else rejected.subtract(seen.select(*rejected.columns))
    rejected.write.mode("overwrite").partitionBy("reason").parquet(_folder(quarantine, batch))


def _folder(zone: str, batch: str) -> str:
    return f"{zone.rstrip('/')}/batch={batch}"


def _others(spark, zone: str, batch: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(zone)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.listStatus(path):
        return None
    return spark.read.parquet(zone).filter(F.col("batch").cast("string") != batch)
