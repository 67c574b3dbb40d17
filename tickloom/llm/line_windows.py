"""Line deduplication over overlapping windows of three lines.

Every run of three consecutive lines of a document is hashed; of equal windows
the first one in the table (smallest document id, then the earliest line) stays
and later ones are removed.  Windows overlap, so the removed positions of a
document are merged before lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import numbered
from tickloom.session import settle

WINDOW_LINES = 3


def removed_lines(docs: DataFrame, window: int = WINDOW_LINES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row_id, doc_id, lines, removed: the lines of each document and the sorted positions to remove.

    Lines end at a line feed; a null text is one empty line.  Documents with
    fewer lines than a window keep all of them.  Rows with the same id follow
    each other by where they are stored, null ids come first.
    """
    lines = numbered(docs, doc_id=id_column, text=text_column).select(
        "row_id", "doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")
    )
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    key = lambda i: F.md5(F.concat_ws("\n", F.slice("lines", i + 1, window)))  # noqa: E731  no line holds a line feed
    windows = lines.filter(F.size("lines") >= window).select(
        "row_id", "doc_id", F.posexplode(F.transform(starts, lambda i: F.unhex(key(i)))).alias("at", "key")
    )
    first = (
        windows.groupBy("key")
        .agg(F.min(F.struct("doc_id", "row_id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    later = windows.join(first, "key").filter(
        (F.col("row_id") != F.col("first.row_id")) | (F.col("at") != F.col("first.at"))
    )
    # a document's own positions: never more than it has lines
    covered = later.groupBy("row_id").agg(F.collect_set("at").alias("at")).select(
        "row_id",
        F.sort_array(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + window - 1))))).alias("removed"),
    )
    # merged at any size: what is removed grows with the table
    return lines.join(settle(covered).hint("merge"), "row_id", "left").withColumn(
        "removed", F.coalesce("removed", F.array().cast("array<int>"))
    )


def without_repeated_lines(marked: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text: what stays of each document."""
    gone = F.map_from_arrays("removed", F.transform("removed", lambda _: F.lit(True)))
    stay = F.filter("lines", lambda _, i: ~F.map_contains_key(gone, i))
    kept = F.when(F.size("removed") == 0, F.concat_ws("\n", "lines")).otherwise(F.concat_ws("\n", stay))
    return marked.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), kept.alias("text"))
