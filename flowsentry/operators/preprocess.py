"""Preprocessing fitted on benign training rows (D11 = C1 C2 D3 E1 E2 B7 E3 B8).

Three passes in all: split sizes with train means, the centered Pearson
Gramian (per-partition numpy partial sums), and the medians (exact
quantiles, scalable path in ``quantiles``).  Only
p-sized statistics reach the driver; the transform is a projection with
literals.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import finite_or_zero, impute, standardize
from . import quantiles as Q
from .sampling import BENIGN_TRAIN_FRACTION, SEED, assign_split

CORR_THRESHOLD = 0.9


def centered_gramian(train: DataFrame, features: list[str], means: list[float]) -> np.ndarray:
    """Sum over rows of (x - mean)(x - mean)^T: each partition returns its
    p x p partial sum (numpy), combined by a p*p-row aggregate.  Centering on
    the exact means keeps the sums well conditioned."""
    p = len(features)
    mu = np.asarray(means, dtype=np.float64)

    def partial(batches):
        acc = np.zeros((p, p))
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=np.float64) - mu
            if len(x):
                acc += x.T @ x
        yield pd.DataFrame({"v": [acc.ravel().tolist()]})

    parts = train.select(*features).mapInPandas(partial, "v array<double>")
    cells = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    g = np.zeros(p * p)
    for r in cells:
        g[r["i"]] = r["x"]
    return g.reshape(p, p)


CONSTANT_EPS = 10 * np.finfo(np.float64).eps  # a std below this is a constant column


def correlation_from_gramian(g: np.ndarray, n: int | None = None) -> np.ndarray:
    """Pearson r; NaN where a column is constant (never prunes)."""
    d = np.sqrt(np.clip(np.diag(g), 0.0, None))
    const = d <= CONSTANT_EPS * np.sqrt(max(n or 1, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = g / np.outer(d, d)
    r[const, :] = np.nan
    r[:, const] = np.nan
    return r


def correlation_matrix(train: DataFrame, features: list[str]) -> np.ndarray:
    """Pearson matrix of the (complete) training rows: one means pass, one
    centered Gramian pass."""
    row = train.agg(*[F.avg(f).alias(f) for f in features]).first()
    means = [row[f] or 0.0 for f in features]
    n = train.count()
    return correlation_from_gramian(centered_gramian(train, features, means), n)


def prune_correlated(features: list[str], corr: np.ndarray, threshold: float = CORR_THRESHOLD) -> list[str]:
    """Drop column j when |r(i, j)| > threshold for any earlier i, even an
    i that is itself dropped; NaN (constant column) never triggers a drop."""
    a = np.abs(corr)
    dropped = []
    for j in range(len(features)):
        col = a[:j, j]
        if np.any(np.nan_to_num(col, nan=-1.0) > threshold):
            dropped.append(features[j])
    return dropped


@dataclass(frozen=True)
class Preprocessor:
    features: list[str]
    dropped: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    stds: list[float]
    n_train: int = 0
    n_val: int = 0
    seed: int = SEED
    corr_threshold: float = CORR_THRESHOLD
    train_share: float = BENIGN_TRAIN_FRACTION
    candidates: list[str] = field(default_factory=list)
    corr: list[list[float | None]] = field(default_factory=list)  # Pearson r over candidates

    def scaled_columns(self, prefix: str = "") -> dict:
        """B7 + B8 as expressions: name -> (impute(x) - mean) / scale."""
        return {prefix + f: standardize(impute(f, m), mu, s)
                for f, m, mu, s in zip(self.features, self.medians, self.means, self.scales)}

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Adds (or replaces, with prefix '') the scaled feature columns."""
        present = set(df.columns)
        missing = {f: F.lit(None).cast("double") for f in self.features if f not in present}
        if missing:
            df = df.withColumns(missing)  # B6: absent feature = missing value
        return df.withColumns(self.scaled_columns(prefix))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Preprocessor":
        return Preprocessor(**json.loads(text))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """Long table: feature, kept, median, mean, std (dropped rows null)."""
        rows = []
        kept = dict(zip(self.features, zip(self.medians, self.means, self.stds)))
        for f in self.candidates or self.features:
            if f in kept:
                m, mu, sd = kept[f]
                rows.append((f, True, m, mu, sd))
            else:
                rows.append((f, False, None, None, None))
        return spark.createDataFrame(
            rows, "feature string, kept boolean, median double, mean double, std double")


def fit_preprocess(df: DataFrame, features: list[str], seed: int = SEED,
                   corr_threshold: float = CORR_THRESHOLD,
                   train_share: float = BENIGN_TRAIN_FRACTION, has_split: bool = False) -> tuple[Preprocessor, DataFrame]:
    """Returns the fitted preprocessor and ``df`` with a ``split`` column
    (``has_split``: it has that of ``assign_split`` already).

    Three passes: (1) split sizes and train means, (2) the centered train
    Gramian (Pearson r, and the population std of every column), (3) exact
    medians of the kept columns.  Train rows are complete by construction
    (C2), so median imputation leaves them unchanged and the scaler moments
    of the imputed train rows are the raw train moments."""
    split_df = df if has_split else assign_split(df, features, seed, train_share)
    stats = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                          *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)]).collect()
    by = {r["split"]: r for r in stats}
    n_train = by["train"]["n"] if "train" in by else 0
    n_val = by["val"]["n"] if "val" in by else 0
    train = split_df.where(F.col("split") == "train").select(*features)
    all_means = [float(by["train"][f"m_{i}"]) if n_train else 0.0 for i in range(len(features))]
    if n_train > 1:
        g = centered_gramian(train, features, all_means)
        corr = correlation_from_gramian(g, n_train)
        var = np.clip(np.diag(g) / n_train, 0.0, None)
    else:
        corr = np.eye(len(features))
        var = np.zeros(len(features))
    dropped = prune_correlated(features, corr, corr_threshold)
    kept = [f for f in features if f not in dropped]
    idx = [features.index(f) for f in kept]
    med = Q.quantiles(train, kept, [0.5])
    medians = [finite_or_zero(med[f][0]) for f in kept]
    means = [all_means[i] for i in idx]
    stds = [float(math.sqrt(var[i])) for i in idx]
    scales = [s if s > CONSTANT_EPS and math.isfinite(s) else 1.0 for s in stds]
    corr_list = [[None if np.isnan(v) else float(v) for v in row] for row in np.asarray(corr)]
    prep = Preprocessor(kept, dropped, medians, means, scales, stds, n_train, n_val,
                        seed, corr_threshold, train_share, list(features), corr_list)
    return prep, split_df


def correlation_frame(spark: SparkSession, features: list[str], corr: np.ndarray) -> DataFrame:
    rows = [(features[i], features[j], None if np.isnan(corr[i, j]) else float(corr[i, j]))
            for i in range(len(features)) for j in range(i + 1, len(features))]
    return spark.createDataFrame(rows, "a string, b string, r double")
