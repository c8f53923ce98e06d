"""Exact quantiles with linear interpolation (numpy's default definition).

Histogram refinement, at every size: each pass buckets the values that still
lie in a candidate interval into ``buckets`` equal-width bins, keeps the bin
holding the wanted rank and narrows to that bin's real min/max.  The least and
the greatest value fall into different bins, so every pass narrows; it ends
when the interval is one value, 2-4 passes for real-valued data.

Many (column, q) targets share a pass, and ranks that share an interval share
its bins.  A task adds up its bins in arrays (a few numbers per interval and
bin, whatever its rows) and sends the bins that have rows; they are merged per
(interval, bin), and the driver gets the one bin that holds each wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 2048


def quantiles(df: DataFrame, cols: list[str], qs: list[float], buckets: int = BUCKETS) -> dict[str, list[float | None]]:
    """{col: [value at q for q in qs]}; nulls and NaN are ignored, None if no rows."""
    return _refine(df, cols, qs, buckets) if cols else {}


@dataclass
class _Target:
    col: str
    rank: int          # 0-based rank wanted
    lo: float
    hi: float
    below: int         # rows strictly below lo
    value: float | None = None


def _refine(df: DataFrame, cols: list[str], qs: list[float], buckets: int) -> dict:
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    base = base.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    stats = base.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)],
                     *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
                     *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)]).first()
    targets: dict[tuple[str, int], _Target] = {}
    plan: dict[str, list[tuple[int, int, float]]] = {}
    for i, c in enumerate(cols):
        n = stats[f"n_{i}"]
        plan[c] = []
        if not n:
            continue
        for q in qs:
            pos = q * (n - 1)
            r0 = int(math.floor(pos))
            r1 = min(r0 + 1, n - 1)
            plan[c].append((r0, r1, pos - r0))
            for r in (r0, r1):
                if (c, r) not in targets:
                    targets[(c, r)] = _Target(c, r, stats[f"lo_{i}"], stats[f"hi_{i}"], 0)
    for t in targets.values():
        if t.lo == t.hi:
            t.value = t.lo
    while active := [t for t in targets.values() if t.value is None]:
        _refine_pass(base, active, buckets)
    res = {}
    for c in cols:
        if not plan[c]:
            res[c] = [None] * len(qs)
            continue
        vals = []
        for r0, r1, frac in plan[c]:
            a, b = targets[(c, r0)].value, targets[(c, r1)].value
            vals.append(a + (b - a) * frac)
        res[c] = vals
    return res


def bin_of(x: np.ndarray, lo: float, hi: float, buckets: int) -> np.ndarray:
    """Bins of values from ``lo`` to ``hi``; ``hi`` alone is in the last one."""
    scale = 1.0 if math.isfinite(hi - lo) else 0.5          # halves, where the width is beyond a double
    width = hi * scale - lo * scale
    place = np.floor((x * scale - lo * scale) / width * buckets) if math.isfinite(width) else np.where(x == lo, 0, 1)
    return np.where(x == hi, buckets - 1, np.minimum(place, buckets - 2)).astype(np.int64)


class Bins:
    """Count, least and greatest value of each bin of some intervals."""

    def __init__(self, intervals: list[tuple[str, float, float]], buckets: int):
        self.intervals, self.buckets = intervals, buckets
        shape = (len(intervals), buckets)
        self.n, self.low, self.high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)

    def add(self, columns: dict[str, np.ndarray]) -> None:
        for k, (c, lo, hi) in enumerate(self.intervals):
            x = columns[c]
            x = x[(x >= lo) & (x <= hi)]
            if len(x):
                b = bin_of(x, lo, hi, self.buckets)
                self.n[k] += np.bincount(b, minlength=self.buckets)
                np.minimum.at(self.low[k], b, x)
                np.maximum.at(self.high[k], b, x)

    def rows(self) -> pa.RecordBatch:
        k, b = np.nonzero(self.n)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(self.n[k, b]),
                                           pa.array(self.low[k, b]), pa.array(self.high[k, b])], names=["k", "b", "n", "mn", "mx"])


def _refine_pass(base: DataFrame, active: list[_Target], buckets: int) -> None:
    intervals = sorted({(t.col, t.lo, t.hi) for t in active})
    number = {i: k for k, i in enumerate(intervals)}
    used = sorted({c for c, _, _ in intervals})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(intervals, buckets)
        for batch in batches:
            bins.add({c: batch.column(c).drop_null().to_numpy(zero_copy_only=False) for c in used})
        yield bins.rows()

    wanted = base.sparkSession.createDataFrame(
        [(i, number[t.col, t.lo, t.hi], t.rank - t.below) for i, t in enumerate(active)], "t int, k int, want long")
    below = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    merged = (base.select(*used).mapInArrow(count, "k int, b int, n long, mn double, mx double")
              .groupBy("k", "b").agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
              .withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))))
    found = (merged.join(F.broadcast(wanted), "k")
             .where((F.col("below") <= F.col("want")) & (F.col("want") < F.col("below") + F.col("n")))
             .select("t", "below", "mn", "mx").collect())
    for r in found:
        t = active[r["t"]]
        t.below += r["below"]
        t.lo, t.hi = r["mn"], r["mx"]
        if t.lo == t.hi:
            t.value = t.lo
