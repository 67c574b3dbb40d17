"""Prices made comparable across splits and dividends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.layout import Layout, carry_in, own_rows, settled


def with_adjustment(df: DataFrame, lay: Layout, actions: DataFrame) -> DataFrame:
    """Adds ``factor`` (all later actions), ``adjusted`` (close) and ``adjusted_volume`` (splits alone).

    ``actions`` has symbol, day (the first bar on new terms), ratio (new units
    for an old one) and dividend (per old unit); several of a day multiply.  An
    action on a day without a bar takes effect on the next bar.  The product
    runs backwards; a chunk is handed that of the chunks after it.
    """
    steps = actions.groupBy("symbol", "day").agg(
        F.product(F.coalesce("ratio", F.lit(1.0))).alias("_ratio"), F.sum(F.coalesce("dividend", F.lit(0.0))).alias("_dividend")
    )
    lay.reach("the close before an action", back=1)
    df = df.withColumns({"_day": F.to_date("ts"), "_before": F.lag("close").over(lay.window())})
    df = own_rows(df, lay)
    # a step belongs to the first bar on or after its day; only days of bars are looked through
    days = df.select("symbol", F.col("_day").alias("day")).distinct().withColumn("_bar_day", F.col("day"))
    ahead = Window.partitionBy("symbol").orderBy("day").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    placed = (
        days.unionByName(steps, allowMissingColumns=True).withColumn("_day", F.min("_bar_day").over(ahead))
        .filter(F.col("_ratio").isNotNull() & F.col("_day").isNotNull())
        .groupBy("symbol", "_day").agg(F.product("_ratio").alias("_ratio"), F.sum("_dividend").alias("_dividend"))
    )
    df = df.join(placed, ["symbol", "_day"], "left")
    split = F.coalesce("_ratio", F.lit(1.0))
    paid = F.coalesce(1 - F.try_divide(F.col("_dividend"), F.col("_before")), F.lit(1.0))
    first = F.row_number().over(Window.partitionBy(*lay.groups, "_day").orderBy("ts")) == 1     # of several bars of a day
    df = df.withColumns({"_split": F.when(first, split).otherwise(1.0), "_step": F.when(first, paid / split).otherwise(1.0)})
    later = lay.window().rowsBetween(1, Window.unboundedFollowing)
    if lay.chunked:
        def scan(chunks: DataFrame, order: Layout) -> DataFrame:
            after = order.window().rowsBetween(1, Window.unboundedFollowing)
            return chunks.select(*lay.keys, "chunk", F.product("_steps").over(after).alias("_step_in"), F.product("_splits").over(after).alias("_split_in"))

        df = carry_in(settled(df, lay), lay, {"_steps": F.product("_step"), "_splits": F.product("_split")}, scan, first_too=True)
    one = F.lit(1.0)
    factor, splits = F.coalesce(F.product("_step").over(later), one), F.coalesce(F.product("_split").over(later), one)
    if lay.chunked:
        factor, splits = factor * F.coalesce("_step_in", one), splits * F.coalesce("_split_in", one)
    return df.withColumns({"factor": factor, "_splits_after": splits}).withColumns({
        "adjusted": F.col("close") * F.col("factor"), "adjusted_volume": F.col("volume") * F.col("_splits_after"),
    }).drop("_day", "_before", "_ratio", "_dividend", "_split", "_step", "_step_in", "_split_in", "_splits_after")
