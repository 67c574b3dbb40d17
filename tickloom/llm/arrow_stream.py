"""Token ids as Arrow stream files of equal batches.

A file holds one run of ids, cut into sequences of equal length: column ``ids``
is a fixed-size list of unsigned 16- or 32-bit integers, column ``mask`` a
fixed-size list of booleans that is false on the padding of the file's last
sequence.  Every batch but the last has the same number of sequences, so all
batch messages have the same size and batch k lies at
``first + k * stride``: a stream can be read at random, and from a memory map
without a copy.  An index row per document says where its ids are.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.words import encoder

SEQUENCE = 2_048
BATCH = 64
INDEX = "doc_id long, part int, file string, place long, n_tokens long"


def _schema(sequence: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([
        pa.field("ids", pa.list_(pa.field("item", kind, nullable=False), sequence), nullable=False),
        pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), sequence), nullable=False),
    ])


class StreamWriter:
    """Appends runs of ids; batches leave as soon as they are full."""

    def __init__(self, sink, sequence: int = SEQUENCE, batch: int = BATCH, wide: bool = False):
        self.sequence, self.size = sequence, sequence * batch
        self.schema = _schema(sequence, wide)
        self.kind = np.uint32 if wide else np.uint16
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    @property
    def place(self) -> int:
        return self.written + self.held

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= self.size:
            run = np.concatenate(self.waiting)
            full = self.held // self.size * self.size
            for i in range(0, full, self.size):
                self._write(run[i:i + self.size], self.size)
            self.waiting, self.held = [run[full:].copy()], self.held - full
            self.written += full

    def _write(self, run: np.ndarray, size: int) -> None:
        ids, mask = np.zeros(size, self.kind), np.zeros(size, bool)
        ids[: len(run)], mask[: len(run)] = run, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            run = np.concatenate(self.waiting)
            self._write(run, -(-len(run) // self.sequence) * self.sequence)
        self.out.close()


class StreamReader:
    """Random access to a file written by :class:`StreamWriter`."""

    def __init__(self, uri: str):
        system, path = pa.fs.FileSystem.from_uri(uri)
        local = isinstance(system, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.schema = pa.ipc.read_schema(self.source)
        self.first = self.source.tell()
        self.sequence = self.schema.field("ids").type.list_size
        message = pa.ipc.read_message(self.source)
        self.stride = self.source.tell() - self.first
        self.per_batch = pa.ipc.read_record_batch(message, self.schema).num_rows
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.first + k * self.stride)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence_at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        found, row = self.batch(k // self.per_batch), k % self.per_batch
        return found.column("ids")[row].values.to_numpy(), found.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def run(self, place: int, n: int) -> np.ndarray:
        """``n`` ids from ``place`` on."""
        size = self.per_batch * self.sequence
        parts = []
        while n:
            k, at = divmod(place, size)
            if self._last[0] != k:
                self._last = (k, self.batch(k).column("ids").flatten().to_numpy())
            part = self._last[1][at:at + n]
            parts.append(part)
            place, n = place + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint16)])


def write_documents(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    sequence: int = SEQUENCE,
    batch: int = BATCH,
) -> DataFrame:
    """Writes the ids of all documents in ascending id order and returns the index that was written beside them.

    Each range of ids is one file; the index row names the file its attempt
    wrote, so a task that runs again leaves at most an unnamed file.  Null ids
    come first, rows with the same id follow each other by text; a null text
    is empty and has the end id only; other columns are not read.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(docs[f"`{id_column}`"].alias("doc_id"), docs[f"`{text_column}`"].alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        wide = enc.tokenizer.get_vocab_size() > 1 << 16
        writer, name = None, f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.arrows"
        end = np.array([end_id], "<u4")
        for rows in batches:
            if writer is None:
                system, path = pa.fs.FileSystem.from_uri(name)
                system.create_dir(path.rpartition("/")[0])
                sink = system.open_output_stream(path)
                writer = StreamWriter(sink, sequence, batch, wide)
            places, sizes = [], []
            for text in rows.column("text").to_pylist():
                ids = np.concatenate([enc.ids(text), end])
                places.append(writer.place)
                sizes.append(len(ids))
                writer.append(ids)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                ["doc_id", "part", "file", "place", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            sink.close()

    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_documents(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, place: read back from the files that ``index`` names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for rows in batches:
            sums = []
            for file, place, n in zip(*[rows.column(c).to_pylist() for c in ("file", "place", "n_tokens")], strict=True):
                if file != name:
                    name, reader = file, StreamReader(file)
                sums.append(zlib.crc32(reader.run(place, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sums, pa.int64())], [*rows.schema.names, "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))        # one row a file
    starts = files.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return index.mapInArrow(read, f"{INDEX}, ids_crc32 long").join(starts, "part").select(
        "doc_id", (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file", "place"
    )
