"""Column expressions for cleaning, imputing, scaling, thresholding and fusion.

Fitted state enters as literals, so every transform below is a projection
that Catalyst folds into the scan's whole-stage-codegen stage.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROBUST_EPS = 1e-9  # fixed value: added to the MAD in robust z


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonfinite_to_null(c: Column | str) -> Column:
    """+-Infinity and NaN become missing (null)."""
    x = _c(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: nonfinite_to_null(f) for f in features})


def narrow_float32(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Optional float32 narrowing at the boundary (features stay double
    by default; narrowing halves cached/shuffled bytes when exactness to
    float32 is acceptable)."""
    return df.withColumns({f: F.col(f).cast("float") for f in features})


def reindex(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``features`` in order; absent ones become null, extras drop."""
    present = set(df.columns)
    cols = [F.col(k) for k in keep if k in present]
    cols += [F.col(f) if f in present else F.lit(None).cast("double").alias(f) for f in features]
    return df.select(*cols)


def finite_or_zero(v: float | None) -> float:
    return float(v) if v is not None and math.isfinite(v) else 0.0


def impute(c: Column | str, median: float | None) -> Column:
    """Missing -> fitted median (non-finite median -> 0)."""
    return F.coalesce(nonfinite_to_null(c), F.lit(finite_or_zero(median)))


def standardize(c: Column, mean: float, scale: float) -> Column:
    """(x - mean) / scale; ``scale`` is already 1 for constant columns."""
    return (c - F.lit(float(mean))) / F.lit(float(scale))


def flag_gt(score: Column | str, thr: float | Column) -> Column:
    """B10 for SVM-sweep, AE and fused scores: flagged when score > thr."""
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    return (_c(score) > t).cast("byte")


def flag_ge(score: Column | str, thr: float | Column) -> Column:
    """B10 for the isolation forest: flagged when score >= thr."""
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    return (_c(score) >= t).cast("byte")


def robust_z(c: Column | str, median: float, mad_plus_eps: float) -> Column:
    """(x - median) / (MAD + 1e-9) with reference stats as literals."""
    return (_c(c).cast("double") - F.lit(float(median))) / F.lit(float(mad_plus_eps))


def weighted_sum(cols: Sequence[Column | str], weights: Sequence[float]) -> Column:
    """sum_i w_i * z_i (two scores in the reference; any number here)."""
    out = None
    for c, w in zip(cols, weights):
        term = F.lit(float(w)) * _c(c)
        out = term if out is None else out + term
    return out


def mean_square(cols: Sequence[Column | str]) -> Column:
    """Mean over columns of x^2 (reconstruction error of the zero model)."""
    total = None
    for c in cols:
        t = _c(c) * _c(c)
        total = t if total is None else total + t
    return total / F.lit(float(len(cols)))


def max_abs(cols: Sequence[Column | str]) -> Column:
    return F.greatest(*[F.abs(_c(c)) for c in cols]) if len(cols) > 1 else F.abs(_c(cols[0]))


def recon_mse(x: Column | str, xhat: Column | str) -> Column:
    """Mean over features of (xhat - x)^2 for two array columns."""
    sq = F.zip_with(_c(x), _c(xhat), lambda a, b: (b.cast("double") - a.cast("double")) * (b.cast("double") - a.cast("double")))
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v) / F.size(_c(x)).cast("double")
