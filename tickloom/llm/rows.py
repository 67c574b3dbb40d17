"""Rows that can be told apart, whatever ids a table has."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import new_folder, settle

TASK_BYTES = 16 << 20       # of a written table that one task reads


def _place(docs: DataFrame) -> Column:
    place = docs.metadataColumn("_metadata")
    return F.xxhash64(place["file_path"], place["row_index"])


def _scan(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a scan that knows where its rows are stored, else a written copy."""
    try:
        docs.select(_place(docs)).schema  # noqa: B018  (resolves the plan)
        return docs
    except AnalysisException:
        return settle(docs)


def numbered(docs: DataFrame, **columns: str) -> DataFrame:
    """``row_id`` plus the named columns (new name = column of ``docs``).

    The id is a 64-bit hash of where the row is stored (file and place in it),
    so it stays the same when a lost task runs again, and rows with null or
    repeated ids differ.  A frame that is not a plain scan is written first.
    """
    docs = _scan(docs)
    return docs.select(_place(docs).alias("row_id"), *[docs[f"`{c}`"].alias(n) for n, c in columns.items()])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered_whole(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns and the row id, with the name of the id, for operators that give rows back as they came."""
    docs = _scan(docs)
    name = free_name(docs, "_row")
    return docs.select("*", _place(docs).alias(name)), name


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ids are in column ``row_id`` of ``dropped``."""
    whole, name = numbered_whole(docs)
    return whole.join(dropped.select(F.col("row_id").alias(name)), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` and goes on from the written table, in as many partitions as its bytes ask for.

    What later steps do with a small table then takes a few tasks, and none of
    it is shuffled where one task holds it all.
    """
    spark = df.sparkSession
    path = new_folder(spark, "settled")
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return spark.read.schema(df.schema).parquet(path).coalesce(max(1, -(-size // TASK_BYTES)))


def settled(df: DataFrame) -> DataFrame:
    """Like :func:`written`; shuffle files that only earlier steps needed are let go."""
    done = written(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short batches, so that what a task derives from whole texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
