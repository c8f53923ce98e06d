"""Fully connected autoencoder n -> h1 -> h2 -> h3 -> h2 -> h1 -> n (ReLU
between layers, linear output), trained on the cluster without torch.

Training rows are dealt to ``slots`` workers by a hash of row_id (a parameter,
not a cluster setting).  In an epoch each worker starts from the broadcast
parameters and Adam moments, takes minibatch steps (MSE loss, L2 added to the
gradient) over its rows, shuffled in windows by a seed of epoch and slot, and
gives its parameters and moments times its rows; they are added up on the
executors in slot order (``operators.tree``) and the driver gets one vector,
the average.  A model is therefore the same whatever the partition settings;
one slot is plain sequential minibatch Adam.  The best epoch is kept by mean
validation MSE.  Scoring is a forward pass in doubles over blocks of rows of
an Arrow batch, with broadcast weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..tree import SLOTS, add_up, per_slot, slotted, with_scores

BATCH = 1024
EPOCHS = 8
WINDOW = 16
SCORED = 512
BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8


def layer_dims(n_in: int, h1: int, h2: int, h3: int) -> list[int]:
    return [n_in, h1, h2, h3, h2, h1, n_in]


def init_params(dims: list[int], seed: int) -> list[np.ndarray]:
    """U(+-1/sqrt(fan_in)) for weights and biases."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(dims[:-1], dims[1:]):
        bound = 1.0 / np.sqrt(a)
        out.append(rng.uniform(-bound, bound, size=(b, a)))
        out.append(rng.uniform(-bound, bound, size=b))
    return out


def forward(params: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    acts = [x]
    h = x
    n_layers = len(params) // 2
    for i in range(n_layers):
        h = h @ params[2 * i].T
        h += params[2 * i + 1]
        if i < n_layers - 1:
            np.maximum(h, 0.0, out=h)
        acts.append(h)
    return h, acts


def recon_mse(params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    h = x
    for i in range(0, len(params), 2):
        h = h @ params[i].T
        h += params[i + 1]
        if i < len(params) - 2:
            np.maximum(h, 0.0, out=h)
    h -= x
    h *= h
    return np.mean(h, axis=1)


class _Grads:
    """Gradients over batches of at most ``batch`` rows, in buffers that are
    kept from step to step."""

    def __init__(self, params: list[np.ndarray], batch: int):
        widths, dtype = [b.size for b in params[1::2]], params[0].dtype
        self.acts, self.deltas = ([np.empty((batch, k), dtype) for k in widths] for _ in range(2))
        self.on, self.ones = [np.empty((batch, k), bool) for k in widths], np.ones(batch, dtype)

    def __call__(self, params: list[np.ndarray], x: np.ndarray, into: list[np.ndarray]) -> list[np.ndarray]:
        n, last = len(x), len(self.acts) - 1
        acts = [x, *(a[:n] for a in self.acts)]
        for i in range(last + 1):
            h = np.matmul(acts[i], params[2 * i].T, out=acts[i + 1])
            h += params[2 * i + 1]
            if i < last:
                np.maximum(h, 0.0, out=h)
        delta = np.subtract(acts[-1], x, out=self.deltas[last][:n])
        delta *= 2.0 / x.size
        for i in reversed(range(last + 1)):
            np.matmul(delta.T, acts[i], out=into[2 * i])
            np.matmul(self.ones[:n], delta, out=into[2 * i + 1])
            if i > 0:
                delta = np.matmul(delta, params[2 * i], out=self.deltas[i - 1][:n])
                delta *= np.greater(acts[i], 0, out=self.on[i - 1][:n])
        return into


def _grads(params, x):
    return _Grads(params, len(x))(params, x, [np.empty_like(p) for p in params])


def _flat(arrs):
    return np.concatenate([a.ravel() for a in arrs])


def _unflat(vec, like):
    out, k = [], 0
    for a in like:
        out.append(vec[k:k + a.size].reshape(a.shape))
        k += a.size
    return out


@dataclass
class AutoEncoder:
    dims: list[int]
    params: list[np.ndarray]
    cols: tuple[str, ...]

    def score(self, df: DataFrame, out_col: str = "ae_score") -> DataFrame:
        return with_scores(df, list(self.cols), [out_col], self.scorer(df))

    def scorer(self, df: DataFrame):
        """For ``with_scores``: rows to their reconstruction MSE."""
        shared = df.sparkSession.sparkContext.broadcast(self.params)

        def start():
            params = shared.value

            def of(x: np.ndarray) -> np.ndarray:
                out = np.empty((len(x), 1))
                for at in range(0, len(x), SCORED):
                    out[at:at + SCORED, 0] = recon_mse(params, x[at:at + SCORED])
                return out
            return of
        return start


def prepare(train_df: DataFrame, val_df: DataFrame, cols: list[str], slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows dealt to their slots, both persisted;
    shareable by every trial of a search."""
    return tuple(slotted(df, cols, slots).persist(StorageLevel.MEMORY_AND_DISK) for df in (train_df, val_df))


class _Worker:
    """Adam steps of one slot in one epoch, over windows of ``WINDOW``
    shuffled batches."""

    def __init__(self, state, shapes, lr, weight_decay, batch, seed):
        vectors, self.t = state
        like = [np.zeros(s) for s in shapes]
        self.flat = [x.astype(np.float32) for x in vectors]
        self.p, self.m, self.v = (_unflat(x, like) for x in self.flat)      # views
        self.g = np.empty_like(self.flat[0])
        self.grads, self.grads_of = _unflat(self.g, like), _Grads(self.p, batch)
        self.lr, self.wd, self.batch, self.rng = lr, weight_decay, batch, np.random.default_rng(seed)
        self.held, self.waiting, self.steps, self.n = [], 0, 0, 0

    def add(self, x: np.ndarray) -> None:
        self.held.append(x.astype(np.float32, copy=False))
        self.waiting += len(x)
        size = WINDOW * self.batch
        if self.waiting >= size:
            rows = np.vstack(self.held)
            whole = len(rows) - len(rows) % size
            for at in range(0, whole, size):
                self._steps(rows[at:at + size])
            self.held, self.waiting = [rows[whole:]], len(rows) - whole

    def _steps(self, rows: np.ndarray) -> None:
        rows = rows[self.rng.permutation(len(rows))]
        for at in range(0, len(rows), self.batch):
            self.steps += 1
            self.grads_of(self.p, rows[at:at + self.batch], self.grads)
            _adam_step(*([x] for x in (*self.flat, self.g)), self.t + self.steps, self.lr, self.wd, *BETAS)
        self.n += len(rows)

    def end(self) -> tuple:
        if self.waiting:
            self._steps(np.vstack(self.held))
        return self.n, self.steps, 0.0, self.n * np.concatenate(self.flat).astype(np.float64)


def train(train_df: DataFrame, val_df: DataFrame, cols: list[str], arch: tuple[int, int, int],
          lr: float, weight_decay: float, epochs: int = EPOCHS, batch: int = BATCH,
          seed: int = 42, slots: int = SLOTS,
          prepared: tuple[DataFrame, DataFrame] | None = None) -> tuple[AutoEncoder, float, list[float]]:
    """(best model, its mean validation MSE, that of each epoch); rows need a
    row_id.  ``prepared`` are the two tables of ``prepare`` with the same slots."""
    sc = train_df.sparkSession.sparkContext
    dims = layer_dims(len(cols), *arch)
    params = init_params(dims, seed)
    shapes = [p.shape for p in params]
    base, val = prepared or prepare(train_df, val_df, cols, slots)
    vectors, t = [_flat(params), *(np.zeros(sum(p.size for p in params)) for _ in range(2))], 0
    best_val, best_params, history = float("inf"), params, []
    for epoch in range(epochs):
        shared = sc.broadcast((vectors, t))
        start = lambda slot, shared=shared, epoch=epoch: _Worker(shared.value, shapes, lr, weight_decay, batch, (seed, epoch, slot))
        n, steps, _, total = add_up(per_slot(base, cols, start, _Worker.add, _Worker.end), slots)
        if not n:
            break
        vectors, t = np.split(total / n, 3), t + steps
        params = _unflat(vectors[0], params)
        history.append(mean_mse(val, cols, params, slots))
        if history[-1] < best_val:
            best_val, best_params = history[-1], params
    if prepared is None:
        base.unpersist()
        val.unpersist()
    return AutoEncoder(dims, best_params, tuple(cols)), best_val, history


def mean_mse(rows: DataFrame, cols: list[str], params: list[np.ndarray], slots: int) -> float:
    """Mean per-row reconstruction MSE over ``slotted`` rows."""
    shared = rows.sparkSession.sparkContext.broadcast(params)

    def start(_):
        return {"n": 0, "sse": 0.0, "params": [p.astype(np.float32) for p in shared.value]}

    def add(state, x):
        state["n"] += len(x)
        for at in range(0, len(x), BATCH):
            state["sse"] += float(recon_mse(state["params"], x[at:at + BATCH].astype(np.float32, copy=False)).sum(dtype=np.float64))

    parts = per_slot(rows, cols, start, add, lambda s: (s["n"], 0, s["sse"], np.zeros(1)))
    n, _, sse, _ = add_up(parts, slots)
    return sse / n if n else float("inf")


def _adam_step(P, M, V, G, t, lr, wd, b1, b2):
    for i in range(len(P)):
        g = G[i] + wd * P[i]
        M[i] *= b1
        M[i] += (1 - b1) * g
        V[i] *= b2
        V[i] += (1 - b2) * g * g
        mh = M[i] / (1 - b1 ** t)
        vh = V[i] / (1 - b2 ** t)
        P[i] -= lr * mh / (np.sqrt(vh) + ADAM_EPS)
