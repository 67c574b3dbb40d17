"""Run log: results with run id, parameters and time, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(results: DataFrame, path: str, run_id: str, params: str) -> None:
    results.select(
        F.lit(run_id).alias("run_id"), F.lit(params).alias("params"), F.current_timestamp().alias("logged_at"), "*"
    ).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
