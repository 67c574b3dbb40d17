"""What a series of returns went through: its growth, peaks and falls, per symbol, year and market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.compare import EPS
from tickloom.plans.layout import WHOLE_ROWS, Layout, carry_in, lay_out, own_rows, settled


def with_path(df: DataFrame, lay: Layout, log: str = "_log") -> DataFrame:
    """Adds ``growth`` (running log return), ``peak`` (its highest, the start included), ``fall`` (log, at most 0)
    and ``underwater`` (bars since the series last stood at its peak).

    A chunk needs four numbers of the ones before it: their growth, their
    highest point, the last bar that stood there and the first bar.  One
    summary row per chunk holds them, and they merge along the chunks, so
    there is one carry for all.
    """
    local = {"growth": F.sum(log).over(lay.so_far())}
    df = own_rows(df, lay).withColumns(local)
    df = df.withColumn("peak", F.max("growth").over(lay.so_far()))
    zero = F.lit(0.0)
    if lay.chunked:
        top = F.when(F.col("growth") >= F.col("peak") - EPS, F.col("bar_no"))
        totals = {"_sum": F.sum(log), "_high": F.max("growth"), "_top": F.max(top), "_first": F.min("bar_no")}

        def scan(chunks: DataFrame, order: Layout) -> DataFrame:
            chunks = chunks.withColumn("_grown", F.coalesce(F.sum("_sum").over(order.before()), zero))
            chunks = chunks.withColumn("_reached", F.greatest(F.max(F.col("_grown") + F.col("_high")).over(order.before()), zero))
            stands = F.col("_grown") + F.col("_high") >= F.coalesce("_reached", zero) - EPS
            return chunks.select(
                *lay.keys, "chunk", "_grown", "_reached",
                F.last(F.when(stands, F.col("_top")), ignorenulls=True).over(order.before()).alias("_stood"),
                F.min("_first").over(order.everything()).alias("_begin"),
            )

        df = carry_in(settled(df, lay), lay, totals, scan, first_too=True)
        grown = F.coalesce("_grown", zero)
        df = df.withColumns({"growth": F.col("growth") + grown, "peak": F.greatest(F.col("peak") + grown, F.coalesce("_reached", zero), zero)})
        stood, begin = F.col("_stood"), F.col("_begin")
    else:
        df = df.withColumns({"peak": F.greatest("peak", zero), "_begin": F.min("bar_no").over(lay.so_far())})
        stood, begin = F.lit(None).cast("long"), F.col("_begin")
    at_peak = F.when(F.col("growth") >= F.col("peak") - EPS, F.col("bar_no"))
    last = F.coalesce(F.max(at_peak).over(lay.so_far()), stood, begin - 1)
    return df.withColumns({
        "fall": F.least(F.col("growth") - F.col("peak"), zero), "underwater": F.col("bar_no") - last,
    }).drop("_grown", "_reached", "_stood", "_begin")


def path_terms() -> dict[str, Column]:
    """Aggregates over bars with a path; they combine map-side."""
    drawdown = -F.expm1("fall")
    return {
        "bars": F.count(F.lit(1)),
        "log_return": F.sum("_log"),
        "max_drawdown": F.max(drawdown),
        "avg_drawdown": F.avg(drawdown),
        "longest_drawdown": F.max("underwater"),
        "drawdowns": F.count_if(F.col("underwater") == 1),
    }


def path_metrics(returns: DataFrame, lay: Layout, value: str = "bar_ret") -> DataFrame:
    """Per symbol and year, per symbol (year NULL), and for the market (symbol NULL).

    A year starts at its own peak; the market holds all symbols in equal
    parts, bar by bar.  Missing returns are no bars.
    """
    bars = own_rows(returns, lay).filter(F.col(value).isNotNull()).withColumn("_log", F.log1p(value)).withColumn("year", F.year("ts"))
    kept = ["ts", "bar_no", "year", "_log", *(["chunk", "own"] if lay.chunked else [])]
    bars = bars.select(*lay.keys, *kept)
    market = returns.filter(F.col(value).isNotNull()) if not lay.chunked else own_rows(returns, lay).filter(F.col(value).isNotNull())
    mean = market.groupBy("ts").agg(F.log1p(F.avg(value)).alias("_log")).select(F.lit("").alias("symbol"), "ts", "_log")
    together, all_ = lay_out(mean, not lay.chunked and mean.count() <= WHOLE_ROWS, lay.chunk_rows)
    together = own_rows(together, all_).withColumn("year", F.year("ts"))

    def levels(df: DataFrame, by: Layout) -> list[DataFrame]:
        terms = [c.alias(n) for n, c in path_terms().items()]
        yearly = with_path(df, by.per("year")).groupBy(*by.keys, "year").agg(*terms)
        whole = with_path(df, by).groupBy(*by.keys).agg(*terms).withColumn("year", F.lit(None).cast("int"))
        return [yearly, whole.select(*yearly.columns)]

    parts = levels(bars, lay)
    parts += [p.withColumn("symbol", F.lit(None).cast("string")) for p in levels(together, all_)]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return table


def rolling_max_drawdown(df: DataFrame, lay: Layout, *bars: int, value: str = "close") -> DataFrame:
    """``max_drawdown_<n>``: the deepest fall within the last n bars, NULL before there are n.

    A fall cannot be subtracted from a frame, so bars are cut into blocks of
    n.  A frame is the end of one block and the start of the next: the deepest
    fall lies in one of the two or reaches from the peak of the first to the
    low of the second.  Both parts are running extremes inside a block, so a
    frame costs the same whatever n is.
    """
    price = F.col(value)
    for n in bars:
        lay.reach(f"a fall within {n} bars", back=n - 1)
        df = df.withColumn("_part", F.floor((F.col("bar_no") - 1) / n))
        inside = lay.window("_part", order=["bar_no"])
        start, end = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
        df = df.withColumns({
            "_low": F.min(price).over(start), "_fallen": price / F.max(price).over(start),
            "_peak_on": F.max(price).over(end), "_fall_on": F.min(price).over(end) / price,
        })
        df = df.withColumns({"_fallen": F.min("_fallen").over(start), "_fall_on": F.min("_fall_on").over(end)})
        back = lay.window(order=["_part", "bar_no"])
        peak, on = F.lag("_peak_on", n - 1).over(back), F.lag("_fall_on", n - 1).over(back)
        whole = F.col("bar_no") % n == 0        # the frame is one block
        worst = F.when(whole, F.col("_fallen")).otherwise(F.least("_fallen", on, F.col("_low") / peak))
        df = df.withColumn(f"max_drawdown_{n}", F.when(F.col("bar_no") >= n, 1 - worst))
        df = df.drop("_part", "_low", "_fallen", "_peak_on", "_fall_on")
    return own_rows(df, lay)
