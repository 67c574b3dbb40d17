"""Streaming bars: ingest, dedupe, tumbling and sliding summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.session import new_folder


def stream_events(spark: SparkSession, folder: str, files: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """Event files of a folder as a stream.

    ``ts`` becomes a TIMESTAMP, as watermarks need one.  ``per_batch`` bounds
    the files of a micro-batch.
    """
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def dedupe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once; ids are forgotten when the watermark has passed them."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def summarise(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """Bars per event type and window; partial sums are combined before the shuffle.

    In append mode a window appears when the watermark has passed its end and
    rows older than the watermark are dropped.  ``delay=None`` keeps the
    watermark of the incoming stream.
    """
    if delay:
        events = events.withWatermark("ts", delay)
    order = F.struct("ts", "event_id")
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.groupBy(F.col("event_type").alias("symbol"), span)
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume"),
        )
    )


def run_to_folder(stream: DataFrame, name: str, out: str | None = None) -> str:
    """Runs a stream over everything available; returns the Parquet folder it wrote.

    Output and stream state go to the shared folder, so a restarted run goes on
    where the last one stopped (give it the same ``out``); nothing passes
    through the driver.
    """
    out = out or new_folder(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(run_to_folder(stream, name))


def stream_table(spark: SparkSession, folder: str, schema: StructType, delay: str = "1 hour") -> DataFrame:
    """The table another stream wrote, as a stream with its own watermark on ts."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ts", delay)
