"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import shared_path

LONG_MAX = (1 << 63) - 1


class Scratch:
    """Intermediate tables of one operator call, written as parquet below the
    cluster's shared folder: they cut lineage, keep columns apart for later
    scans, and survive lost executors.  ``drop`` removes a table that no later
    step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_path(spark, name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def row_numbering() -> Iterator[int]:
    """Row ids of the running task: unique over the whole input, the same
    again when a task of a file scan is repeated."""
    base = TaskContext.get().partitionId() << 33
    i = 0
    while True:
        yield base + i
        i += 1


def run_hashes(df: DataFrame, col: str, lengths: list[int]) -> DataFrame:
    """For an array column of longs, adds ``col``_k for each k of ``lengths``
    over 1: hashes of all runs of k elements, in order (null if it has fewer),
    each put together from runs of 1, 2, 4 ... elements."""
    def joined(df: DataFrame, a: int, b: int) -> DataFrame:
        """Runs of a + b elements from those of a and of b."""
        size = F.size(col) - (a + b - 1)
        left, right = (col if k == 1 else f"{col}_{k}" for k in (a, b))
        return df.withColumn(f"{col}_{a + b}", F.when(size > 0, F.zip_with(
            F.slice(left, F.lit(1), size), F.slice(right, F.lit(a + 1), size), lambda x, y: F.xxhash64(x, y))))

    have = {1}
    while 2 * max(have) <= max(lengths, default=1):
        df, have = joined(df, max(have), max(have)), have | {2 * max(have)}
    for k in sorted(set(lengths)):
        at = 0
        for p in sorted((1 << i for i in range(k.bit_length()) if k >> i & 1), reverse=True):
            if at and at + p not in have:
                df, have = joined(df, at, p), have | {at + p}
            at += p
    return df


def run_hash(parts: list[Column]) -> Column:
    """The hash of one run, as in ``run_hashes``."""
    def whole(xs: list[Column]) -> Column:
        return xs[0] if len(xs) == 1 else F.xxhash64(whole(xs[:len(xs) // 2]), whole(xs[len(xs) // 2:]))

    out, at = None, 0
    for p in sorted((1 << i for i in range(len(parts).bit_length()) if len(parts) >> i & 1), reverse=True):
        own = whole(parts[at:at + p])
        out, at = own if out is None else F.xxhash64(out, own), at + p
    return out


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The one large table that a worker keeps from task to task; one of
    another key takes its place."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Frees the worker's table, for tasks that need the memory for another."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        _trim()


def _trim() -> None:
    """Gives freed memory back to the system; a C library that can't is left alone."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at the task's end its worker, which Spark keeps
    for the next one, gives the freed memory back."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()
    return whole


def texts(column: pa.Array) -> Iterator[str | None]:
    """Python strings of an Arrow column, one at a time."""
    for x in column:
        yield x.as_py()


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by ``key`` (a long column
    without nulls); a group may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, key: str, parts: int, *order: str) -> DataFrame:
    """Rows of a key together in one partition, sorted, for ``grouped``."""
    return df.repartition(parts, key).sortWithinPartitions(key, *order)


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """At least the session's shuffle partitions, more for more rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (long columns a, b): root is
    the smallest node that links reach.

    Alternating large-star and small-star steps, each one aggregate and one
    join on the star's centre, so a hub's links stay spread over tasks (a
    skewed join is split by AQE); every step is a written table.  Stops when a
    step changes nothing."""
    def ordered(df: DataFrame) -> DataFrame:
        return (df.where("a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = scratch.table(ordered(links), "links")
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(ordered(large), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        small = scratch.table(ordered(small), "small")
        scratch.drop(large, edges)
        edges, before = small, now
        now = state(edges)
        if now == before:
            break
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
