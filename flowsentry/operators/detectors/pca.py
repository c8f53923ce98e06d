"""PCA reconstruction error: a cheap, deterministic reconstruction scorer.

The principal axes come from ``pyspark.ml.feature.PCA`` (one distributed
covariance pass, p x p to the driver).  With orthonormal axes V the squared
residual is |x|^2 - |V^T x|^2, so the score is a plain column expression
(k projections of p terms) that stays inside whole-stage codegen.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_axes(train: DataFrame, cols: list[str], k: int | None = None) -> np.ndarray:
    k = k or max(1, math.ceil(len(cols) / 2))
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(train.select(*cols))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    return model.pc.toArray()  # p x k


def with_recon_error(df: DataFrame, cols: list[str], axes: np.ndarray, out_col: str) -> DataFrame:
    """Appends the mean squared reconstruction residual over the p features.
    Projections are a separate projection stage so each is computed once."""
    k = axes.shape[1]
    proj = {f"_pc{j}": sum((F.lit(float(axes[i, j])) * F.col(c) for i, c in enumerate(cols)), F.lit(0.0))
            for j in range(k)}
    staged = df.withColumns(proj)
    sq = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    proj_sq = sum((F.col(f"_pc{j}") * F.col(f"_pc{j}") for j in range(k)), F.lit(0.0))
    err = F.greatest(sq - proj_sq, F.lit(0.0)) / F.lit(float(len(cols)))
    return staged.withColumn(out_col, err).drop(*proj)
