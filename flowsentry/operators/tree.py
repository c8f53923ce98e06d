"""Sums of vectors over rows, added up on the executors.

Rows are dealt to a fixed number of ``slots`` by a hash of their key, and
slots, not partitions, are what gets one partial result: it doesn't hang on
the cluster's partition settings.  Each slot is a partition of its own.
Training reads the rows many times, so they are kept packed: a row of the
dealt table holds up to an Arrow batch of them as one block of single
precision numbers, which goes to Python as it lies in memory.  Partial vectors
are added in groups of ``FAN`` neighbours, level by level, in slot order; the
driver gets one vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FAN = 16
SLOTS = 8
PACKED = "slot int, x binary"
PARTIAL = "slot int, n long, steps long, value double, vec array<double>"
_PARTIAL = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("steps", pa.int64()), ("value", pa.float64()), ("vec", pa.list_(pa.float64()))])


def matrix(columns: Sequence[pa.Array], dtype: type = np.float64) -> np.ndarray:
    """Rows by columns; nulls are NaN."""
    out = np.empty((len(columns[0]), len(columns)), dtype=dtype)
    for j, c in enumerate(columns):
        out[:, j] = c.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def slotted(df: DataFrame, cols: list[str], slots: int = SLOTS, key: str = "row_id") -> DataFrame:
    """(slot, x), the rows of a slot in one partition of its own and in hash
    order; x holds ``cols`` of some of them, row by row."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix([batch.column(c) for c in cols], np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("slot").slice(0, 1), pa.array([x.tobytes()], pa.binary())], names=["slot", "x"])

    order = F.xxhash64(key, F.lit(1))
    return (df.select(F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"), order.alias("_order"), *cols)
            .repartitionById(slots, "slot").sortWithinPartitions("_order", *cols).select("slot", *cols).mapInArrow(pack, PACKED))


def per_slot(rows: DataFrame, cols: list[str], start: Callable[[int], object], add: Callable[[object, np.ndarray], None],
             end: Callable[[object], tuple]) -> DataFrame:
    """One PARTIAL row for each slot of ``slotted`` rows: a state from
    ``start(slot)``, fed with blocks of rows by ``add``, gives (n, steps,
    value, vec) by ``end``."""
    p = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, state = None, None

        def out() -> pa.RecordBatch:
            n, steps, value, vec = end(state)
            return pa.RecordBatch.from_pydict({"slot": [slot], "n": [n], "steps": [steps], "value": [value], "vec": [vec]}, schema=_PARTIAL)

        for batch in batches:
            own, blocks = batch.column("slot").to_numpy(), batch.column("x")
            for i in range(batch.num_rows):
                if own[i] != slot:
                    if slot is not None:
                        yield out()
                    slot, state = int(own[i]), start(int(own[i]))
                add(state, np.frombuffer(blocks[i].as_buffer(), dtype=np.float32).reshape(-1, p))
        if slot is not None:
            yield out()

    return rows.mapInArrow(run, PARTIAL)


def add_up(partials: DataFrame, slots: int) -> tuple[int, int, float, np.ndarray | None]:
    """(sum of n, largest steps, sum of value, sum of vec); vec is None if
    there is no partial."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        total = np.array(pdf["vec"].iloc[0], dtype=np.float64)
        for v in pdf["vec"].iloc[1:]:
            total = total + np.asarray(v)
        return pd.DataFrame({"slot": [int(pdf["slot"].iloc[0]) // FAN], "n": [int(pdf["n"].sum())],
                             "steps": [int(pdf["steps"].max())], "value": [float(sum(pdf["value"]))], "vec": [total]})

    while slots > 1:
        partials = partials.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(add, PARTIAL)
        slots = -(-slots // FAN)
    row = partials.first()
    if row is None:
        return 0, 0, 0.0, None
    return row["n"], row["steps"], row["value"], np.array(row["vec"])


def with_scores(df: DataFrame, cols: list[str], names: list[str], scorer: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Appends double columns ``names``: a task's ``scorer()`` maps rows x
    ``cols`` to rows x ``names``; a NaN is a null.  Only ``cols`` go to Python."""
    @F.arrow_udf(StructType([StructField(c, DoubleType()) for c in names]))
    def scores(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        score = scorer()
        for columns in batches:
            s = score(matrix(columns))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(s[:, k]), from_pandas=True) for k in range(len(names))], names=names)

    at = "_scores"
    while at in df.columns:
        at = "_" + at
    return df.withColumn(at, scores(*cols)).select(*df.columns, *[F.col(at)[c].alias(c) for c in names])
