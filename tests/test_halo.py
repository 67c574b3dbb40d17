"""Queries that read further back than the halo of the rule catalogue, where a supplier is too large for one task."""

import duckdb
from compare import assert_same
from pyspark.sql import functions as F

from tickloom.catalog import CHECKS, QUERIES, registry
from tickloom.plans.layout import WHOLE_ROWS


def test_short_long_ema_of_a_large_supplier(spark, tmp_path):
    rows = WHOLE_ROWS + 1_000
    lines = spark.range(rows + 500).select(
        F.when(F.col("id") < rows, 1).otherwise(2).cast("long").alias("l_suppkey"),
        F.date_add(F.lit("1992-01-01").cast("date"), (F.col("id") % 2_500).cast("int")).alias("l_shipdate"),
        ((F.col("id") * 7_919 % 90_001) / 100.0 + 9.0).alias("l_extendedprice"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert not registry.sizes(spark, str(tmp_path)).whole
    duck = duckdb.connect()
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert_same(QUERIES["short_long_ema"](spark, str(tmp_path)), duck, CHECKS["short_long_ema"])
