"""Isolation forest fitted and applied on the cluster.

Fit: every training row draws ``copies`` different trees (a hashed start and
a hashed step without common factor with the number of trees), each kept with
a probability that gives a tree ~1.5 x psi candidates; one
``groupBy(tree).applyInPandas`` builds all trees in parallel, each from
the psi candidates with the smallest hash (so a group never exceeds the
bounded candidate count, however large the input): a sample without
replacement, in which no row stands twice.  Trees come back as flat
node rows (tree, node, feature, threshold, left, right, size).

Score: the forest is broadcast by value, each tree as a full binary tree in
arrays (the children of node i are 2i + 1 and 2i + 2; a leaf's own value stands
in all of its places on the last level), and a ``mapInArrow`` moves all rows
of a batch down each tree a level at a time, with a few array steps a level.
score = 2 ** (-E[h(x)] / c(psi)), higher = more anomalous (the negated
score_samples of the usual formulation).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ...functions.hashing import hash_bits, hash_unit

N_TREES = 300
PSI = 256
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _build_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feats, thr, left, right, size = [], [], [], [], []

    def grow(idx: np.ndarray, depth: int) -> int:
        node = len(feats)
        feats.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            return node
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feats[node], thr[node] = f, t
        left[node] = grow(idx[mask], depth + 1)
        right[node] = grow(idx[~mask], depth + 1)
        return node

    grow(np.arange(len(x)), 0)
    return feats, thr, left, right, size


@dataclass(frozen=True)
class Forest:
    nodes: pd.DataFrame  # flat node table
    psi: int
    cols: tuple[str, ...]

    def _arrays(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each tree its features and thresholds by place, and the path
        lengths (with the leaf correction c(size)) of the last level's places."""
        out = []
        for _, t in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            feat, left, right, size = (t[c].to_numpy(np.int64) for c in ("feature", "left", "right", "size"))
            thr = t["threshold"].to_numpy(np.float64)
            feats, thrs, nodes, grown = [], [], np.zeros(1, np.int64), np.zeros(1)
            while (feat[nodes] >= 0).any():
                inner = feat[nodes] >= 0
                feats.append(np.where(inner, feat[nodes], 0))
                thrs.append(thr[nodes])
                grown = np.repeat(grown + inner, 2)
                nodes = np.stack([np.where(inner, left[nodes], nodes), np.where(inner, right[nodes], nodes)], axis=1).ravel()
            lengths = grown + np.array([c_factor(float(v)) for v in size[nodes]])
            out.append((np.concatenate([*feats, np.zeros(0, np.int64)]), np.concatenate([*thrs, np.zeros(0)]), lengths))
        return out

    def score(self, df: DataFrame, out_col: str = "if_score") -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast((self._arrays(), self.psi))
        cols = list(self.cols)
        schema = StructType(df.schema.fields + [StructField(out_col, DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, psi = bc.value
            cpsi = c_factor(psi)
            for batch in batches:
                n = batch.num_rows
                x = np.concatenate([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.float64) for c in cols])
                row, total = np.arange(n), np.zeros(n)
                for feat, thr, lengths in trees:
                    place, start = np.zeros(n, np.int64), feat * n
                    for _ in range(len(lengths).bit_length() - 1):
                        at = start.take(place)
                        at += row
                        on_right = ~(x.take(at) < thr.take(place))
                        place *= 2
                        place += 1
                        place += on_right
                    total += lengths.take(place - (len(lengths) - 1))
                mean_h = total / max(len(trees), 1)
                scores = np.power(2.0, -mean_h / cpsi) if cpsi > 0 else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out_col])

        return df.mapInArrow(run, schema)


def tree_slots(rows: DataFrame, n_trees: int, per_row: float, seed: int) -> DataFrame:
    """Rows with a tree and a rank ``h`` for each of the about ``per_row`` (at
    most ``n_trees``) different trees that a row is drawn for."""
    copies = min(n_trees, max(1, math.ceil(per_row)))
    keep = min(1.0, per_row / copies)
    steps = [s for s in range(1, max(2, n_trees)) if math.gcd(s, n_trees) == 1]
    start, pick = (hash_bits("row_id", f"if{what}{seed}") for what in ("tree", "step"))
    return (rows.withColumn("_start", start)
            .withColumn("_step", F.element_at(F.array(*map(F.lit, steps)), (pick % F.lit(len(steps)) + 1).cast("int")))
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .withColumn("key", F.concat_ws("#", "row_id", F.col("copy").cast("string")))
            .where(hash_unit("key", f"ifkeep{seed}") < F.lit(keep))
            .withColumn("tree", F.pmod(F.col("_start") % F.lit(n_trees) + F.col("copy") * F.col("_step"), F.lit(n_trees)).cast("int"))
            .withColumn("h", hash_bits("key", f"ifrank{seed}")).drop("_start", "_step"))


def fit(train: DataFrame, cols: list[str], n_trees: int = N_TREES, psi: int = PSI,
        seed: int = 42, n_rows: int | None = None) -> Forest:
    n = train.count() if n_rows is None else n_rows
    psi_eff = max(1, min(psi, n))
    want = 1.5 * n_trees * psi_eff
    slots = tree_slots(train.select(*cols, "row_id"), n_trees, want / max(n, 1), seed)
    max_depth = int(math.ceil(math.log2(max(psi_eff, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["h", "key"]).head(psi_eff)
        x = pdf[cols].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, t])
        f, th, le, ri, sz = _build_tree(x, rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(f)), "feature": f, "threshold": th,
                             "left": le, "right": ri, "size": sz})

    nodes = slots.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    return Forest(nodes, psi_eff, tuple(cols))
