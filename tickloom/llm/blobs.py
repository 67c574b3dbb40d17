"""Numbers dealt to buckets as packed rows.

Where a task makes millions of small records, it sorts them by the bucket they
go to and hands on one row of packed bytes per bucket; the task that gets a
bucket unpacks them into one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SCHEMA = "bucket int, packed binary"
NAMES = ["bucket", "packed"]


def bucket_count(spark: SparkSession) -> int:
    """Buckets for one shuffle: a few for each of its partitions."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(records: np.ndarray, bucket: np.ndarray) -> list[tuple[int, bytes]]:
    """One (bucket, packed records) pair for each bucket that gets any."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(bucket)]
    return [(int(bucket[s]), records[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]


def batch(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.int32()), pa.array([p for _, p in pairs], pa.binary())], NAMES)


def unpack(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("packed").to_pylist()), kind)


def spread(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype("u8", copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
