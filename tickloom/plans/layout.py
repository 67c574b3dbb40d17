"""How ordered series are spread over tasks.

Every window of this library runs inside a :class:`Layout`.  Two layouts give
the same results:

* *whole*: one window group per key.  One shuffle, one sort.  Used only when
  the largest key is known to hold at most ``WHOLE_ROWS`` rows.
* *chunked*: each key is cut into runs of ``chunk_rows`` bars, so a key that
  holds a third of all rows is spread over as many tasks as its size asks for.
  Frames with a bounded look-back read a halo of earlier bars that is copied
  into the chunk; a frame or smoothing that reaches beyond it is refused.
  Scans without a bound (running sums, positions, equity) add a carry computed
  from one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import settle

WHOLE_ROWS = 262_144        # largest key that may stay in one window group
TASK_ROWS = 250_000        # bars per task up to which one task per core is enough
CHUNK_ROWS = 262_144        # bars per chunk beyond that
BLOCK_ROWS = 512            # smoothing block, see operators.smoothing
HALO_BACK = 4_096           # covers every bounded look-back of the rule catalogue
HALO_AHEAD = 8              # fills look at the next bars
BUCKET_ROWS = 250_000       # rows of a key numbered by one task


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    chunked: bool = False
    chunk_rows: int = CHUNK_ROWS
    block_rows: int = BLOCK_ROWS
    back: int = HALO_BACK
    ahead: int = HALO_AHEAD
    spread: bool = False        # few keys: what multiplies their bars is dealt out anew

    def reach(self, what: str, back: int = 0, ahead: int = 0) -> None:
        """Refuses a look-back or look-ahead that the halo of a chunk does not hold."""
        if self.chunked and (back > self.back or ahead > self.ahead):
            raise ValueError(
                f"{what} reads {back} bars back and {ahead} ahead; chunks were laid out with {self.back} and {self.ahead}"
            )

    @property
    def groups(self) -> list[str]:
        return [*self.keys, "chunk"] if self.chunked else list(self.keys)

    def window(self, *extra: str, order: Sequence[str] | None = None) -> WindowSpec:
        return Window.partitionBy(*self.groups, *extra).orderBy(*(order or self.order))

    def rows(self, back: int, ahead: int = 0) -> WindowSpec:
        """Frame from ``back`` bars earlier to ``ahead`` bars later."""
        return self.window().rowsBetween(-back, ahead)

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def everything(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def by_block(self) -> Layout:
        """Same groups, sorted so that frames inside a smoothing block need no new sort."""
        return replace(self, order=("block", "ts"))

    def per(self, *names: str) -> Layout:
        """Adds grouping columns, e.g. the rule after bars were stacked by rule."""
        return replace(self, keys=(*self.keys, *names), order=("ts",))


@dataclass(frozen=True)
class KeySizes:
    largest: int
    total: int
    keys: int = 1 << 30

    @property
    def whole(self) -> bool:
        """No key is too large for one window group."""
        return self.largest <= WHOLE_ROWS

    def spread(self, spark: SparkSession) -> bool:
        """Too few keys to keep all cores busy with what their bars are multiplied to."""
        return self.keys < 2 * spark.sparkContext.defaultParallelism and self.total > TASK_ROWS

    def tasks(self, spark: SparkSession) -> int:
        """Tasks for the windows.

        Set outright, as each bar grows by a factor of up to the number of
        rules after the shuffle, which the sizes AQE coalesces by do not show.
        """
        cores = spark.sparkContext.defaultParallelism
        if self.total <= cores * TASK_ROWS:
            return cores
        return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_sizes(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> KeySizes:
    """One map-side combined count over the key columns; two numbers reach the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total, keys = counts.agg(F.max("n"), F.sum("n"), F.count("n")).first()
    return KeySizes(largest or 0, total or 0, keys)


def time_bucket(df: DataFrame, keys: Sequence[str], ts: str = "ts", most: int = BUCKET_ROWS) -> Column:
    """The longest span of time of which no key has more than ``most`` rows."""
    for unit in ("month", "day", "hour", "minute"):
        span = F.date_trunc(unit, ts)
        if (df.groupBy(*keys, span).count().agg(F.max("count")).first()[0] or 0) <= most:
            return span
    return F.date_trunc("second", ts)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "bar_no",
) -> DataFrame:
    """1-based row number per key without ever sorting a whole key in one task.

    ``bucket`` must rise with ``order`` and bound the rows that share one
    value.  Buckets are counted, their starts summed along the key, and rows
    are ranked inside their bucket only.
    """
    marked = df.withColumn("_bucket", bucket)
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        marked.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_place", F.row_number().over(inside))
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_place"))
        .drop("_bucket", "_place", "_start")
    )


def lay_out(
    bars: DataFrame,
    whole: bool,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
    back: int = HALO_BACK,
    ahead: int = HALO_AHEAD,
    spread: bool = False,
) -> tuple[DataFrame, Layout]:
    """Numbers the bars of every symbol (``bar_no``, ``block``) and picks the layout.

    In the chunked layout each bar is copied to the chunks whose halo reaches
    it; ``own`` tells the original from its copies.  ``back`` and ``ahead`` say
    how far that is; operators that need more raise an error.
    """
    if whole:
        lay = Layout(block_rows=block_rows, spread=spread)
        df = bars.withColumn("bar_no", F.row_number().over(lay.window()).cast("long"))
        return _with_block(df, block_rows), lay
    lay = Layout(chunked=True, chunk_rows=chunk_rows, block_rows=block_rows, back=back, ahead=ahead)
    bars = settle(bars)     # read for the span, the starts, the ranks and the counts
    numbered = number_rows(bars, ["symbol"], ["ts"], time_bucket(bars, ["symbol"]))
    index = F.col("bar_no") - 1
    first = F.floor(F.greatest(index - ahead, F.lit(0)) / chunk_rows)
    last = F.floor(F.least(index + back, F.col("_bars") - 1) / chunk_rows)      # no chunk of copies alone
    per_key = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_bars"))
    copies = numbered.join(per_key, "symbol").withColumn("chunk", F.explode(F.sequence(first, last))).drop("_bars")
    df = copies.withColumn("own", F.col("chunk") == F.floor(index / chunk_rows))
    return _with_block(df, block_rows), lay


def _with_block(df: DataFrame, block_rows: int) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("bar_no") / block_rows))


def own_rows(df: DataFrame, lay: Layout) -> DataFrame:
    """Drops halo copies; a no-op in the whole layout."""
    return df.filter("own") if lay.chunked else df


def carry_in(
    df: DataFrame,
    lay: Layout,
    totals: dict[str, Column],
    scan: Callable[[DataFrame, Layout], DataFrame],
    first_too: bool = False,
) -> DataFrame:
    """Adds what the earlier chunks of a key hand over to each row's chunk.

    ``totals`` are aggregates over the rows of one chunk.  ``scan`` gets the
    summary and a layout that orders it by chunk, and returns keys, chunk and
    carry columns.  The summary holds one row per chunk and the first chunk of
    a key is left out of the join (nothing comes before it) unless
    ``first_too`` asks for it, so it grows with rows / chunk_rows only.  Called
    for chunked layouts, on settled frames.
    """
    keys = list(lay.keys)
    summary = own_rows(df, lay).groupBy(*keys, "chunk").agg(*[c.alias(n) for n, c in totals.items()])
    carries = scan(summary, Layout(keys=lay.keys, order=("chunk",)))
    return df.join(carries if first_too else carries.filter(F.col("chunk") > 0), [*keys, "chunk"], "left")


def settled(df: DataFrame, lay: Layout) -> DataFrame:
    return settle(df) if lay.chunked else df


def spread_over(df: DataFrame, *columns: str) -> DataFrame:
    """Deals rows out by ``columns`` to a fixed number of tasks, as sizes after the shuffle do not show the work in them."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *columns)
