"""Expression-only detectors on standardised features.

``zsq``  mean of z^2 over features: the reconstruction error of the all-zero
         reconstruction, an autoencoder stand-in whose value DuckDB can check.
``zmax`` max |z| over features.

``QuantileBoundary`` turns any score into a one-class decision with the
OC-SVM's ν semantics: the boundary is the (1-ν) quantile of the training
scores, so exactly a share ν of training rows falls outside; the decision
score is ``score - boundary`` (> 0 flags).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.expr import max_abs, mean_square
from .. import quantiles as Q


def zsq(cols: list[str]) -> Column:
    return mean_square(cols)


def zmax(cols: list[str]) -> Column:
    return max_abs(cols)


@dataclass(frozen=True)
class QuantileBoundary:
    nus: tuple[float, ...]
    boundaries: tuple[float, ...]

    def decision(self, score: Column | str, nu: float) -> Column:
        s = F.col(score) if isinstance(score, str) else score
        b = self.boundaries[self.nus.index(nu)]
        return s - F.lit(float(b))


def fit_boundaries(train: DataFrame, score_col: str, nus: tuple[float, ...]) -> QuantileBoundary:
    qs = [1.0 - nu for nu in nus]
    vals = Q.quantiles(train, [score_col], qs)[score_col]
    return QuantileBoundary(tuple(nus), tuple(float(v) for v in vals))
