"""Events marked on bars while both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_marks(bars: DataFrame, events: DataFrame, length: str = "1 hour") -> DataFrame:
    """symbol, ts, close, buy_mark, sell_mark of every bar: the close where an event of the kind fell into the bar.

    ``bars`` has symbol, ts, close, ``events`` symbol, at, kind, each with a
    watermark of its own.  An event belongs to the bar it lies in, ``length``
    long.  Both sides are kept until the slower watermark has passed the bar;
    then the bar comes out once, with or without marks.  An event that is later
    than its watermark is dropped, as if it had not happened.
    """
    left = bars.select("symbol", "ts", "close").alias("bar")
    right = events.select(F.col("symbol").alias("_symbol"), "at", "kind").alias("event")
    meets = F.expr(f"symbol = _symbol AND at >= ts AND at < ts + INTERVAL {length}")
    both = left.join(right, meets, "leftOuter")
    kinds = {kind: F.max(F.when(F.col("kind") == kind, 1)) for kind in ("buy", "sell")}
    marked = both.groupBy("symbol", "ts", "close").agg(*[c.alias(f"_{k}") for k, c in kinds.items()])
    return marked.select("symbol", "ts", "close", *[F.when(F.col(f"_{k}") == 1, F.col("close")).alias(f"{k}_mark") for k in kinds])
