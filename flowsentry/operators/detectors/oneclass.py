"""One-class SVM with an RBF kernel, approximated by random Fourier features.

phi(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2*gamma), b ~ U(0, 2*pi), so
phi(x).phi(y) ~ exp(-gamma |x - y|^2).  gamma follows the library default
"scale": 1 / (p * Var(X)) over all training entries.

The ν-model solves, over phi, the one-class problem
    min 1/2 |w|^2 - rho + 1/(ν n) sum max(0, rho - w.phi(x)),
whose dual asks for the shortest vector w among the weighted means of phi(x)
with weights from 0 to 1/(ν n) that sum to 1.

Fit (distributed): a fully corrective conditional gradient.  Given w, the
weighted mean v that is lowest along w is the mean of phi over the share ν of
rows with the smallest w.phi; w becomes the shortest vector in the hull of all
v so far (a problem of as many unknowns as rounds, solved exactly on the
driver).  w.w - w.v bounds how far the objective is from its optimum; a ν
stops when that gap is at most ``tol`` of the objective.  One job a round
serves all ν: rows fall into ``BINS`` bins of w.phi, finest around the mean that
the rows of the last quantile's bin have under the new w, and each bin's count and sum of phi are added up on the executors
(``operators.tree``).  The bin that holds the quantile counts in part, and
with its lower edge in the gap, so the gap is never too small.  The features
of a round are single precision (an error of some 1e-6 in w.phi, far below
``tol``), their sums double; scores are double.

Without ``nus`` one shared model is fitted: w = mean phi(x) over all rows (the
optimum for ν = 1).  The boundary of each ν is the exact quantile of the
scores of the training rows (``plans.study``).

Score column (higher = more anomalous): -w.phi(x); the decision for ν is
score - boundary_ν > 0.  Weights are D x p doubles, broadcast by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tree import SLOTS, add_up, per_slot, slotted, with_scores

N_FEATURES_DEFAULT = 512
TOL = 0.01
ROUNDS = 100
BINS = 32
NEAR = 24
REACH, RATIO = 6.0, 1.7     # edges: how far from the middle (quantile less the mean below it), and from one to the next
BLOCK = 512
CACHED = 1 << 16    # numbers in a block of rows x features

#: -sin(2 pi a) = a * polynomial of a^2 for a from -1/4 to 1/4, at its Chebyshev
#: nodes; off by at most 7e-9 (single) and 2e-16 (double)
_SINE = {
    "float32": (-6.283185280154407, 41.34168061334652, -81.60247636892518, 76.58117264427872, -39.7598270853191),
    "float64": (-6.283185307179585, 41.341702240398284, -81.60524927557977, 76.70585968962867, -42.05868995395094,
                15.09450614073429, -3.817365633469135, 0.6925067010720717),
}


@dataclass(frozen=True)
class RFFMap:
    W: np.ndarray   # D x p
    b: np.ndarray   # D

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.W.T + self.b)


def gamma_scale(df: DataFrame, cols: list[str]) -> float:
    """1 / (p * Var(X)) with Var over every entry of the training matrix."""
    p = len(cols)
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 sum((F.sum(F.col(c)) for c in cols), F.lit(0.0)).alias("s"),
                 sum((F.sum(F.col(c) * F.col(c)) for c in cols), F.lit(0.0)).alias("ss")).first()
    n = (row["n"] or 0) * p
    if n == 0:
        return 1.0 / max(p, 1)
    mean = row["s"] / n
    var = row["ss"] / n - mean * mean
    return 1.0 / (p * var) if var > 0 else 1.0


def make_map(p: int, gamma: float, n_components: int = N_FEATURES_DEFAULT, seed: int = 42) -> RFFMap:
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_components, p))
    b = rng.uniform(0.0, 2.0 * np.pi, size=n_components)
    return RFFMap(W, b)


@dataclass(frozen=True)
class OneClassModel:
    rff: RFFMap
    w: np.ndarray                      # (D,) shared, or (K, D): one row per ν
    cols: tuple[str, ...]
    nus: tuple[float, ...] | None = None
    objective: tuple[float, ...] = ()  # 1/2 |w|^2 per ν
    gap: tuple[float, ...] = ()        # bound on its distance from the optimum
    rounds: int = 0

    def out_cols(self, out_col: str) -> list[str]:
        return [out_col] if self.w.ndim == 1 else [f"{out_col}_{k}" for k in range(self.w.shape[0])]

    def for_nu(self, nu: float) -> OneClassModel:
        """The model of one ν alone (the shared one if there is one for all)."""
        return self if self.w.ndim == 1 else OneClassModel(self.rff, self.w[self.nus.index(nu)], self.cols)

    def score(self, df: DataFrame, out_col: str = "oc_score") -> DataFrame:
        """Appends -w.phi(x) (higher = more anomalous) with Arrow batches;
        one column per ν when the model is per ν (``out_col``_k)."""
        return with_scores(df, list(self.cols), self.out_cols(out_col), self.scorer(df))

    def scorer(self, df: DataFrame):
        """For ``with_scores``: rows to -w.phi, one column per w."""
        shared = df.sparkSession.sparkContext.broadcast((self.rff, np.atleast_2d(self.w)))

        def start():
            rff, w = shared.value
            phi, w = _Phi(rff, np.float64), -w.T

            def of(x: np.ndarray) -> np.ndarray:
                out = np.empty((len(x), w.shape[1]))
                for at, z in phi.blocks(x):
                    np.matmul(z, w, out=out[at:at + len(z)])
                return out
            return of
        return start


def fit(train: DataFrame, cols: list[str], n_components: int = N_FEATURES_DEFAULT,
        seed: int = 42, gamma: float | None = None, nus: tuple[float, ...] | None = None,
        tol: float = TOL, rounds: int = ROUNDS, slots: int = SLOTS, prepared: DataFrame | None = None) -> OneClassModel:
    """``train`` has a row_id beside ``cols``.  ``prepared`` are its rows dealt
    to as many slots (``operators.tree``), where the caller keeps them."""
    g = gamma_scale(train, cols) if gamma is None else gamma
    rff = make_map(len(cols), g, n_components, seed)
    rows = slotted(train, cols, slots).persist(StorageLevel.MEMORY_AND_DISK) if prepared is None else prepared
    try:
        n, total = _mean_sum(rows, cols, rff, slots)
        mean = total / max(n, 1)
        if not nus:
            return OneClassModel(rff, mean, tuple(cols))
        if not n:
            return OneClassModel(rff, np.tile(mean, (len(nus), 1)), tuple(cols), tuple(nus))
        return _solve(rows, cols, rff, mean, n, tuple(nus), tol, rounds, slots)
    finally:
        if prepared is None:
            rows.unpersist()


class _Phi:
    """phi, a block of rows at a time: the angles are taken in turns, so their
    distance from the next whole turn, less a quarter, is what the sine is
    taken of."""

    def __init__(self, rff: RFFMap, dtype: type):
        dim = len(rff.b)
        self.turns, self.rows, self.dtype = np.vstack([rff.W.T, rff.b]) / (2.0 * np.pi), max(16, CACHED // dim), dtype
        self.turns = self.turns.astype(dtype)
        self.sine = [dtype(np.sqrt(2.0 / dim) * c) for c in _SINE[np.dtype(dtype).name]]
        self.held = [np.empty((self.rows, dim), dtype) for _ in range(3)]

    def blocks(self, x: np.ndarray):
        """(place of the first row, phi of a block of rows); a block is
        overwritten by the next."""
        x = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(self.dtype, copy=False)
        for at in range(0, len(x), self.rows):
            block = x[at:at + self.rows]
            yield at, self._of(block, *(h[:len(block)] for h in self.held))

    def _of(self, x: np.ndarray, a: np.ndarray, square: np.ndarray, z: np.ndarray) -> np.ndarray:
        np.matmul(x, self.turns, out=a)
        np.rint(a, out=square)
        a -= square
        np.abs(a, out=a)
        a -= self.dtype(0.25)
        np.multiply(a, a, out=square)
        np.multiply(square, self.sine[-1], out=z)
        for c in self.sine[-2:0:-1]:
            z += c
            z *= square
        z += self.sine[0]
        z *= a
        return z


def _phi(rff: RFFMap):
    """phi of rows, in single precision."""
    phi = _Phi(rff, np.float32)

    def of(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(rff.b)), np.float32)
        for at, z in phi.blocks(x):
            out[at:at + len(z)] = z
        return out
    return of


def _mean_sum(rows: DataFrame, cols: list[str], rff: RFFMap, slots: int) -> tuple[int, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(rff)
    dim = len(rff.b)

    def add(state, x):
        state["n"] += len(x)
        for _, z in state["phi"].blocks(x):
            state["v"] += z.sum(axis=0, dtype=np.float64)

    def start(_):
        return {"n": 0, "v": np.zeros(dim), "phi": _Phi(shared.value, np.float32)}

    n, _, _, total = add_up(per_slot(rows, cols, start, add, lambda s: (s["n"], 0, 0.0, s["v"])), slots)
    return n, np.zeros(dim) if total is None else total


def _edges(rho: float, reach: float, ratio: float = 2.0) -> np.ndarray:
    """BINS - 1 edges around ``rho``, ``ratio`` times as far apart from one to
    the next."""
    half = (BINS - 2) // 2
    steps = reach * ratio ** np.arange(-half + 1.0, 1.0)
    return np.concatenate([rho - steps[::-1], [rho], rho + steps])


class _BinSums:
    """For each w (K) and bin: count and sum of phi, of the bins up to
    ``upto`` (K).  Rows in these bins wait for a block of them."""

    def __init__(self, rff: RFFMap, w: np.ndarray, edges: np.ndarray, upto: np.ndarray):
        k, d = w.shape
        self.phi, self.w, self.edges, self.upto = _Phi(rff, np.float32), w.astype(np.float32), edges, upto
        self.first = np.concatenate([[0], np.cumsum(upto + 1)])     # of each w in the stacked bins
        self.count, self.sums = np.zeros((k, BINS)), np.zeros((self.first[-1], d))
        self.z, self.place, self.waiting = np.empty((BLOCK + self.phi.rows, d), np.float32), np.empty((k, BLOCK + self.phi.rows), np.int64), 0

    def add(self, x: np.ndarray) -> None:
        for _, z in self.phi.blocks(x):
            place = np.empty((len(self.w), len(z)), np.int64)
            for i, w in enumerate(self.w):
                place[i] = np.searchsorted(self.edges[i], (z @ w).astype(np.float64), side="right")
                self.count[i] += np.bincount(place[i], minlength=BINS)
            on = np.flatnonzero((place <= self.upto[:, None]).any(axis=0))
            here = slice(self.waiting, self.waiting + len(on))
            np.take(z, on, axis=0, out=self.z[here], mode="clip")
            self.place[:, here] = place[:, on]
            self.waiting += len(on)
            if self.waiting >= BLOCK:
                self._sum()

    def _sum(self) -> None:
        one = np.zeros((len(self.sums), self.waiting), np.float32)
        for i, last in enumerate(self.upto):
            place = self.place[i, :self.waiting]
            on = np.flatnonzero(place <= last)
            one[self.first[i] + place[on], on] = 1.0
        self.sums += one @ self.z[:self.waiting]
        self.waiting = 0

    def end(self) -> tuple:
        if self.waiting:
            self._sum()
        out = np.zeros((len(self.w), BINS, 1 + self.sums.shape[1]))
        out[:, :, 0] = self.count
        for i, last in enumerate(self.upto):
            out[i, :last + 1, 1:] = self.sums[self.first[i]:self.first[i + 1]]
        return 0, 0, 0.0, out.ravel()


def _bin_sums(rows: DataFrame, cols: list[str], rff: RFFMap, w: np.ndarray, edges: np.ndarray, slots: int,
              upto: np.ndarray) -> np.ndarray:
    """For each w (K) and bin: count and, up to bin ``upto`` of each w, sum of
    phi, K x BINS x (1 + D)."""
    shared = rows.sparkSession.sparkContext.broadcast((rff, w, edges, upto))
    parts = per_slot(rows, cols, lambda _: _BinSums(*shared.value), _BinSums.add, _BinSums.end)
    return add_up(parts, slots)[3].reshape(len(w), BINS, 1 + w.shape[1])


def _quantile_bin(count: np.ndarray, m: float) -> int:
    """The bin of the ``m``-th lowest row."""
    return int(np.flatnonzero(np.cumsum(count) >= m - 1e-9)[0])


def _sums_to_quantile(rows: DataFrame, cols: list[str], rff: RFFMap, w: np.ndarray, edges: np.ndarray, slots: int,
                      m: list[float]) -> np.ndarray:
    """``_bin_sums`` that hold the bin of the ``m``-th lowest row of each w: once
    more up to that bin, where it lies beyond ``NEAR``."""
    upto = np.full(len(w), NEAR)
    sums = _bin_sums(rows, cols, rff, w, edges, slots, upto)
    far = [i for i in range(len(w)) if _quantile_bin(sums[i, :, 0], m[i]) > NEAR]
    if far:
        upto = np.array([_quantile_bin(sums[i, :, 0], m[i]) for i in far])
        sums[far] = _bin_sums(rows, cols, rff, w[far], edges[far], slots, upto)
    return sums


def _lowest_mean(sums: np.ndarray, edges: np.ndarray, w: np.ndarray, m: float) -> tuple[np.ndarray, float, float, float]:
    """Mean of phi over the ``m`` lowest rows by bins, a lower bound of their
    mean w.phi, the place of the quantile, and the width of its bin."""
    count = sums[:, 0]
    before = np.cumsum(count) - count
    b = _quantile_bin(count, m)
    rest = min(m - before[b], count[b])
    full = sums[:b, 1:].sum(axis=0)
    v = (full + sums[b, 1:] * (rest / count[b])) / m
    mean = float(sums[b, 1:] @ w) / count[b]
    low = edges[b - 1] if b else -np.sqrt(2.0) * np.linalg.norm(w)
    high = edges[b] if b < len(edges) else np.sqrt(2.0) * np.linalg.norm(w)
    bound = (float(full @ w) + rest * min(low, mean)) / m
    return v, bound, mean, float(high - low)


def _shortest(atoms: np.ndarray) -> np.ndarray:
    """Weights (at least 0, sum 1) of the shortest vector in the hull of the
    rows: Wolfe's active sets."""
    gram = atoms @ atoms.T
    on = [int(np.argmin(np.diag(gram)))]
    weight = np.zeros(len(atoms))
    weight[on[0]] = 1.0
    for _ in range(20 * len(atoms) + 20):
        slope = gram @ weight
        j = int(np.argmin(slope))
        if slope[j] >= weight @ slope - 1e-12 * max(1.0, gram[j, j]) or j in on:
            return weight
        on.append(j)
        while True:     # shortest in the plane through the active rows, or back to where a weight gets 0
            size = len(on)
            system = np.zeros((size + 1, size + 1))
            system[0, 1:] = system[1:, 0] = 1.0
            system[1:, 1:] = gram[np.ix_(on, on)]
            flat = np.linalg.lstsq(system, np.eye(size + 1)[0], rcond=None)[0][1:]
            if (flat > 1e-12).all():
                weight[:] = 0.0
                weight[on] = flat
                break
            now = weight[on]
            down = now - flat
            back = np.where((flat <= 1e-12) & (down > 0), now / np.where(down > 0, down, 1.0), np.inf)
            step = min(1.0, float(back.min()))
            now = now - step * down
            now[int(np.argmin(back))] = 0.0
            weight[:] = 0.0
            weight[on] = np.maximum(now, 0.0) / np.maximum(now, 0.0).sum()
            on = [i for i in on if weight[i] > 0.0]
    return weight


def _solve(rows: DataFrame, cols: list[str], rff: RFFMap, mean: np.ndarray, n: int, nus: tuple[float, ...],
           tol: float, rounds: int, slots: int) -> OneClassModel:
    w = np.tile(mean, (len(nus), 1))
    atoms = [[mean] for _ in nus]
    gap = np.full(len(nus), np.inf)
    size = float(np.linalg.norm(mean))
    rho, reach, ratio = [size * size] * len(nus), [np.sqrt(2.0) * size] * len(nus), 2.0
    done = 0
    for done in range(1, rounds + 1):
        open_ = [k for k in range(len(nus)) if gap[k] > tol * 0.5 * (w[k] @ w[k])]
        if not open_:
            done -= 1
            break
        edges = np.stack([_edges(rho[k], reach[k], ratio) for k in open_])
        m = [max(1.0, nus[k] * n) for k in open_]
        sums = _sums_to_quantile(rows, cols, rff, w[open_], edges, slots, m)
        found = {k: [] for k in open_}
        for i, k in enumerate(open_):
            v, bound, at, _ = _lowest_mean(sums[i], edges[i], w[k], m[i])
            gap[k] = w[k] @ w[k] - bound
            reach[k] = max(REACH * (at - float(v @ w[k])), 1e-9 * size)
            for j, few in zip(open_, m):
                if nus[j] <= nus[k]:
                    found[j].append(v if j == k else _lowest_mean(sums[i], edges[i], w[k], few)[0])
        for i, k in enumerate(open_):
            if gap[k] > tol * 0.5 * (w[k] @ w[k]):
                hull = np.stack(atoms[k] + found[k])
                weight = _shortest(hull)
                atoms[k] = [a for a, x in zip(hull, weight) if x > 0.0]
                w[k] = weight @ hull
                b = _quantile_bin(sums[i, :, 0], m[i])
                rho[k] = float(sums[i, b, 1:] @ w[k]) / sums[i, b, 0]
        ratio = RATIO
    return OneClassModel(rff, w, tuple(cols), nus, tuple(float(0.5 * x @ x) for x in w), tuple(float(g) for g in gap), done)
