"""Named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.layout import KeySizes, Layout, lay_out
from tickloom.sources.tables import daily_bars, supplier_sizes, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if check:
            CHECKS[name] = check
        return run

    return add


_SIZES: dict[tuple[str, str], KeySizes] = {}


def sizes(spark: SparkSession, folder: str) -> KeySizes:
    """Rows per supplier; asked once per application and folder, as the tables do not change."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SIZES:
        _SIZES[key] = supplier_sizes(table(spark, folder, "lineitem"))
    return _SIZES[key]


def bars_of(spark: SparkSession, folder: str) -> DataFrame:
    return daily_bars(table(spark, folder, "lineitem"), sizes(spark, folder))


def laid(spark: SparkSession, folder: str, back: int | None = None) -> tuple[DataFrame, Layout]:
    """``back`` is asked for where a query reads further back than the halo of the rule catalogue."""
    known = sizes(spark, folder)
    halo = {} if back is None else {"back": back}
    return lay_out(bars_of(spark, folder), known.whole, spread=known.spread(spark), **halo)


def laid_in_chunks(spark: SparkSession, folder: str, back: int, ahead: int = 8, chunk_rows: int = 150) -> tuple[DataFrame, Layout]:
    """The layout of keys too large for one task, whatever the size of the table."""
    return lay_out(bars_of(spark, folder), False, chunk_rows, 64, back, ahead)


def day(column: str = "ts", name: str = "day") -> Column:
    return F.col(column).cast("date").alias(name)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    """Floats rounded for comparison.

    Many indicator values lie exactly between two rounded ones (a mean of 20
    prices in cents), where the last bit decides; a shift far below the last
    digit moves them off the border.  It also turns -0.0 into 0.0.
    """
    return [F.round(F.col(f"`{n}`") + _shift(digits), digits).alias(n) for n in names]


def rounded_sql(*names: str, digits: int = 6) -> str:
    return ", ".join(f'ROUND("{n}" + {_shift(digits)!r}, {digits}) AS "{n}"' for n in names)


def _shift(digits: int) -> float:
    return 0.033 * 10.0**-digits
