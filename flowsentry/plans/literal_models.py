"""Queries that apply learned-model scorers with written-down parameters to the
whole lineitem flow view, so SQL can check what a fitted model computes.

The parameters follow simple rules (``wave``); the features are scaled by
fixed divisors and missing values are 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detectors.autoencoder import AutoEncoder, layer_dims
from ..operators.detectors.iforest import Forest
from ..operators.detectors.oneclass import OneClassModel, RFFMap
from ..sources.tables import lineitem_flows

#: Scaled inputs: flow feature and divisor.
INPUTS = (("qty", 25.0), ("price", 50_000.0), ("disc", 0.05), ("tax", 0.04))
COMPONENTS = 8
HIDDEN = (4, 3, 4)
PSI = 8
#: Trees as rows (tree, node, feature, threshold, left, right, size); feature -1 is a leaf.
NODES = [
    (0, 0, 0, 1.0, 1, 2, 8), (0, 1, 1, 0.8, 3, 4, 4), (0, 2, -1, 0.0, -1, -1, 4), (0, 3, -1, 0.0, -1, -1, 3), (0, 4, -1, 0.0, -1, -1, 1),
    (1, 0, 3, 0.5, 1, 2, 8), (1, 1, -1, 0.0, -1, -1, 2), (1, 2, 2, 1.1, 3, 4, 6), (1, 3, -1, 0.0, -1, -1, 5), (1, 4, -1, 0.0, -1, -1, 1),
]


def wave(n: int, start: float, scale: float) -> list[float]:
    """``n`` numbers scale * sin(start), scale * sin(start + 1), ..., to six places."""
    return [round(scale * math.sin(start + i), 6) for i in range(n)]


def one_class_numbers() -> tuple[list[list[float]], list[float], list[float]]:
    """(W, b, w) of the one-class model."""
    p = len(INPUTS)
    return [wave(p, d * p, 1.0) for d in range(COMPONENTS)], wave(COMPONENTS, 1.0, 3.0), wave(COMPONENTS, 2.0, 0.5)


def autoencoder_numbers() -> list[tuple[list[list[float]], list[float]]]:
    """(weights, bias) of each layer."""
    dims = layer_dims(len(INPUTS), *HIDDEN)
    return [([wave(a, 7 * k + i * a, 0.8) for i in range(b)], wave(b, k, 0.3)) for k, (a, b) in enumerate(zip(dims[:-1], dims[1:]))]


def inputs(spark, sf_dir) -> DataFrame:
    flows = lineitem_flows(spark, sf_dir)
    return flows.select("row_id", *[(F.coalesce(F.col(c), F.lit(0.0)) / F.lit(d)).alias(f"x{i}") for i, (c, d) in enumerate(INPUTS)])


COLS = tuple(f"x{i}" for i in range(len(INPUTS)))


def q_ocsvm_score(spark, sf_dir):
    """F2, B9 on constant Fourier weights."""
    big, b, w = (np.array(x) for x in one_class_numbers())
    out = OneClassModel(RFFMap(big, b), w, COLS).score(inputs(spark, sf_dir), "score")
    return out.select("row_id", F.round("score", 6).alias("score"))


def q_ae_forward(spark, sf_dir):
    """reconstruction error of constant layers."""
    params = [np.array(x) for layer in autoencoder_numbers() for x in layer]
    out = AutoEncoder(layer_dims(len(INPUTS), *HIDDEN), params, COLS).score(inputs(spark, sf_dir), "mse")
    return out.select("row_id", F.round("mse", 6).alias("mse"))


def q_iforest_score(spark, sf_dir):
    """scores of a written-down forest."""
    nodes = pd.DataFrame(NODES, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])
    out = Forest(nodes, PSI, COLS).score(inputs(spark, sf_dir), "score")
    return out.select("row_id", F.round("score", 6).alias("score"))


def literal_queries() -> dict:
    return {"ocsvm_score": q_ocsvm_score, "ae_forward": q_ae_forward, "iforest_score": q_iforest_score}


# ---------------------------------------------------------------- SQL
def oracle_sql(flows: str) -> dict[str, str]:
    """``flows``: the CTEs that end in lf, the flow view."""
    head = f"WITH {flows}, x AS (SELECT row_id, " + ", ".join(
        f"coalesce({c}, 0.0) / {d!r} AS x{i}" for i, (c, d) in enumerate(INPUTS)) + " FROM lf)"
    line = lambda w, names, b: " + ".join([*(f"({v!r}) * {n}" for v, n in zip(w, names)), f"({b!r})"])
    big, b, w = one_class_numbers()
    terms = " + ".join(f"({v!r}) * cos({line(row, COLS, c)})" for row, c, v in zip(big, b, w))
    out = {"ocsvm_score": f"{head} SELECT row_id, round(-sqrt(2.0 / {COMPONENTS}) * ({terms}), 6) AS score FROM x"}

    layers, names, ctes, source = autoencoder_numbers(), COLS, [], "x"
    for k, (weights, bias) in enumerate(layers):
        new = [f"h{k}_{i}" for i in range(len(bias))]
        cells = [line(row, names, c) for row, c in zip(weights, bias)]
        if k < len(layers) - 1:
            cells = [f"greatest({c}, 0.0)" for c in cells]
        ctes.append(f"l{k} AS (SELECT *, " + ", ".join(f"{c} AS {n}" for c, n in zip(cells, new)) + f" FROM {source})")
        names, source = new, f"l{k}"
    error = " + ".join(f"({n} - {x}) * ({n} - {x})" for n, x in zip(names, COLS))
    out["ae_forward"] = f"{head}, {', '.join(ctes)} SELECT row_id, round(({error}) / {len(COLS)}.0, 6) AS mse FROM {source}"

    # average path length of n rows: 0 up to one, 1 for two, else 2 H(n - 1) - 2 (n - 1) / n
    c = lambda n: "0.0" if n <= 1 else "1.0" if n == 2 else f"(2.0 * (ln({n - 1}.0) + 0.5772156649015329) - 2.0 * {n - 1}.0 / {n}.0)"
    by = {(t, n): rest for t, n, *rest in NODES}

    def path(tree: int, node: int, depth: int) -> str:
        feature, threshold, left, right, size = by[tree, node]
        if feature < 0:
            return f"({depth}.0 + {c(size)})"
        return f"CASE WHEN x{feature} < {threshold!r} THEN {path(tree, left, depth + 1)} ELSE {path(tree, right, depth + 1)} END"

    mean = " + ".join(path(t, 0, 0) for t in sorted({r[0] for r in NODES}))
    out["iforest_score"] = f"{head} SELECT row_id, round(pow(2.0, -(({mean}) / 2.0) / {c(PSI)}), 6) AS score FROM x"
    return out
