"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast Hadamard pseudo-rotations (random signs and a
Walsh-Hadamard transform, three times) and hashed to the nearest signed axis.
Two such axes make a cell of a table.  A query looks into the cells with the
highest summed coordinates of every table; what it meets there is ranked by the
exact cosine of the original vectors.

Equal vectors are folded to one before hashing (the smallest ids of a class are
all that can be among the nearest), cells with many vectors or queries are cut
into blocks, and a block returns only its best per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import settle

TABLES = 32
PROBES = 64             # cells a query looks into at least, per table
MET = 200               # vectors that a query meets on average at least; a small table asks for more cells
NEAREST = 5
BLOCK_VECTORS = 20_000  # vectors and queries of a cell that meet in one task
BLOCK_QUERIES = 4_000
SEED = 7

CELL = ["dims", "slot", "axis"]     # slot: table, axis: first signed axis; the second one is compared inside
SIGNED = "dims int, slot int, axis int, second int, cls long, vector binary"
PROBED = "dims int, slot int, axis int, seconds binary, cls long, vector binary"


@lru_cache(maxsize=4)
def _signs(dims: int, tables: int, seed: int) -> np.ndarray:
    size = 1 << max(1, (dims - 1).bit_length())
    return np.random.default_rng([seed, dims]).choice([-1.0, 1.0], (tables, 2, 3, size))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of every row (length a power of two)."""
    size, half = rows.shape[1], 1
    while half < size:
        pairs = rows.reshape(-1, size // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(-1, size)
        half *= 2
    return rows / np.sqrt(size)


def turned(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Coordinates along all signed axes, first the positive ones, after one pseudo-rotation."""
    rows = np.zeros((len(unit), signs.shape[1]))
    rows[:, : unit.shape[1]] = unit
    for flip in signs:
        rows = hadamard(rows * flip)
    return np.concatenate([rows, -rows], axis=1)


def valid(vector: Column) -> Column:
    """Not null or empty, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """dims, class ids, unit vectors and the vectors' bytes, for each length of vector in the batch."""
    cls = batch.column("cls").to_numpy()
    vectors = [np.array(v, "<f8") for v in batch.column("embedding").to_pylist()]
    dims = np.array([len(v) for v in vectors], int)
    for size in np.unique(dims):
        at = np.flatnonzero(dims == size)
        rows = np.stack([vectors[i] for i in at])
        yield int(size), cls[at], rows / np.linalg.norm(rows, axis=1, keepdims=True), [vectors[i].tobytes() for i in at]


def _index(tables: int, seed: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, cls, unit, raw in _unit(batch):
                n = len(cls)
                for slot, signs in enumerate(_signs(dims, tables, seed)):
                    first, second = (turned(unit, s).argmax(1).astype(np.int32) for s in signs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dims] * n, pa.int32()), pa.array([slot] * n, pa.int32()), pa.array(first), pa.array(second), pa.array(cls), pa.array(raw, pa.binary())],
                        [f.split()[0] for f in SIGNED.split(", ")],
                    )

    return index


def _probe(tables: int, probes: int, seed: int, everywhere: bool, rows: int):
    def rows_of(slot, signs, unit) -> Iterator[tuple[int, int, int, np.ndarray]]:
        first, second = (turned(unit, s) for s in signs)
        axes = first.shape[1]
        for i in range(len(unit)):
            if everywhere:
                for axis in range(axes):
                    yield slot, i, axis, np.arange(axes, dtype="<i4")
                continue
            total = (first[i][:, None] + second[i][None, :]).ravel()
            cells = min(len(total), max(probes, -(-MET * len(total) // (tables * max(1, rows)))))
            best = np.argpartition(-total, min(cells, len(total) - 1))[:cells]
            for axis in np.unique(best // axes):
                yield slot, i, int(axis), (best[best // axes == axis] % axes).astype("<i4")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, cls, unit, raw in _unit(batch):
                for slot, signs in enumerate(_signs(dims, tables, seed)):
                    if everywhere and slot:
                        break
                    out = [(dims, s, axis, seconds.tobytes(), int(cls[i]), raw[i]) for s, i, axis, seconds in rows_of(slot, signs, unit)]
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in PROBED.split(", ")])

    return probe


def _meet(keep: int):
    def meet(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or data.empty:
            return pd.DataFrame({"query_cls": [], "cls": [], "score": []}).astype({"query_cls": "int64", "cls": "int64", "score": "float64"})
        vectors = np.stack([np.frombuffer(v, "<f8") for v in data["vector"]])
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        second, cls = data["second"].to_numpy(), data["cls"].to_numpy()
        out = []
        for query, vector, seconds in zip(queries["cls"], queries["vector"], queries["seconds"], strict=True):
            at = np.flatnonzero(np.isin(second, np.frombuffer(seconds, "<i4")))
            if not len(at):
                continue
            q = np.frombuffer(vector, "<f8")
            score = np.einsum("ij,j->i", vectors[at], q) / (norms[at] * np.sqrt(np.einsum("i,i->", q, q)))
            best = np.lexsort((cls[at], -score))[:keep]
            out.append(pd.DataFrame({"query_cls": query, "cls": cls[at][best], "score": score[best]}))
        return pd.concat(out) if out else meet(queries.head(0), data)

    return meet


def _blocks(sizes: dict[tuple, int], block: int) -> dict[tuple, int]:
    return {cell: -(-n // block) for cell, n in sizes.items() if n > block}


def _factor(blocks: dict[tuple, int]) -> Column:
    """Blocks of a row's cell; the map holds only cells beyond one block."""
    if not blocks:
        return F.lit(1)
    pairs = [F.lit(x) for (d, s, a), n in blocks.items() for x in (f"{d},{s},{a}", n)]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws(",", *CELL)], F.lit(1))


def _search(classes: DataFrame, queries: DataFrame, tables: int, probes: int, keep: int, seed: int, everywhere: bool = False) -> DataFrame:
    """query_cls, cls, score: the best of every block a query looks into."""
    data = classes.select("cls", "embedding").mapInArrow(_index(tables, seed), SIGNED)
    if everywhere:
        data = data.filter("slot = 0")
    asked = queries.select("cls", "embedding").mapInArrow(_probe(tables, probes, seed, everywhere, classes.count()), PROBED)
    count = lambda df: {tuple(r[c] for c in CELL): r["n"] for r in df.groupBy(*CELL).count().withColumnRenamed("count", "n").filter(F.col("n") > BLOCK_QUERIES).collect()}  # noqa: E731  cells are at most tables x axes
    by_data, by_query = _factor(_blocks(count(data), BLOCK_VECTORS)), _factor(_blocks(count(asked), BLOCK_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = F.pmod(F.xxhash64("cls"), F.lit(1_000_003))
    left = asked.withColumn("_q", F.pmod(dealt, by_query)).withColumn("_d", every(by_data))
    right = data.withColumn("_d", F.pmod(dealt, by_data)).withColumn("_q", every(by_query))
    key = [*CELL, "_d", "_q"]
    kinds = lambda df: df.select(*[F.col(c).cast("long" if c in ("_d", "_q") else df.schema[c].dataType) for c in df.columns])
    found = kinds(left).groupBy(*key).cogroup(kinds(right).groupBy(*key)).applyInPandas(_meet(keep), "query_cls long, cls long, score double")
    return found.groupBy("query_cls", "cls").agg(F.max("score").alias("score"))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEAREST,
    tables: int = TABLES,
    probes: int = PROBES,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row, by cosine.

    ``is_query`` is a condition on column ``vec_id``.  Rows without an id and
    vectors that are null, empty, zero or hold a null or non-finite component
    take no part; only vectors of the same length are compared; a row is no
    candidate for queries of its own id; equal scores rank by smaller id.  A
    query that meets fewer than ``k`` vectors in its cells is compared with
    all of them.  Other columns are not read.
    """
    rows = vectors.select(vectors[f"`{id_column}`"].alias("vec_id"), vectors[f"`{vector_column}`"].cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    named = rows.groupBy("embedding").agg(F.min("vec_id").alias("cls"))
    members = rows.join(named, "embedding").select("vec_id", "cls", "embedding").dropDuplicates(["vec_id", "cls"])
    members = settle(members)
    first = Window.partitionBy("cls").orderBy("vec_id")
    smallest = members.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    classes = settle(smallest.groupBy("cls").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max_by("embedding", F.lit(1)).alias("embedding")))
    asking = members.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query_cls"))
    queries = classes.join(asking.select(F.col("query_cls").alias("cls")).distinct(), "cls", "left_semi")
    found = settle(_search(classes, queries, tables, probes, k + 1, seed))

    ids = classes.select("cls", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_cls").orderBy(F.desc("score"), "cls")

    def ranked(pairs: DataFrame) -> DataFrame:
        best = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
        listed = asking.join(best, "query_cls").join(ids, "cls").filter("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return listed.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    met = settle(ranked(found))
    few = asking.join(met.groupBy("query_id").count().filter(F.col("count") >= k), "query_id", "left_anti")
    short = classes.join(few.select(F.col("query_cls").alias("cls")).distinct(), "cls", "left_semi")
    if short.isEmpty():
        return met
    again = ranked(settle(_search(classes, short, tables, probes, k + 1, seed, everywhere=True))).join(few.select("query_id"), "query_id", "left_semi")
    return met.join(few.select("query_id"), "query_id", "left_anti").unionByName(again)
