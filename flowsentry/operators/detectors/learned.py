"""Learned detector scores for a ``Study``: ML = one-class SVM on random Fourier features, solved per ν,
DL = autoencoder (best of the seeded random search, min validation MSE).

The training inputs are the study's scaled benign-train rows; an optional
fit-row cap (D4) applies to the one-class fit only, as in the reference.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sampling import ae_draws, fit_sample
from ..tree import with_scores
from . import autoencoder as AE
from . import oneclass as OC


def learned_scores(st) -> DataFrame:
    opts = dict(st.learned_options)
    cols = st.zcols
    scaled = st.scaled      # a projection of the study's written working set
    train = scaled.where(F.col("split") == "train")
    val = scaled.where(F.col("split") == "val")
    oc_rows = opts.get("oc_fit_rows")
    oc_train = fit_sample(train, oc_rows, st.seed)
    slots = opts.get("slots", OC.SLOTS)

    # the one-class fit and the trials are independent: they share one
    # packed, persisted copy of the training rows, and all are submitted
    # from driver threads so that their jobs of ``slots`` tasks fill the
    # cluster together; selection keeps draw order (first minimum wins)
    draws = ae_draws(opts.get("ae_trials", 2), st.seed)
    prepared = AE.prepare(train, val, cols, slots)

    def one_class():
        return OC.fit(oc_train, cols, n_components=opts.get("rff_components", OC.N_FEATURES_DEFAULT), seed=st.seed,
                      nus=tuple(st.nus), tol=opts.get("oc_tol", OC.TOL), rounds=opts.get("oc_rounds", OC.ROUNDS), slots=slots,
                      prepared=prepared[0] if oc_rows is None else None)

    epochs = opts.get("ae_epochs", AE.EPOCHS)

    def one(draw):
        arch, lr, wd = draw
        return AE.train(train, val, cols, arch, lr, wd, epochs=epochs, seed=st.seed, slots=slots, prepared=prepared)

    with (ThreadPoolExecutor(max_workers=1) as beside,
          ThreadPoolExecutor(max_workers=max(1, min(len(draws), opts.get("ae_parallel", 2)))) as pool):
        fitted = beside.submit(one_class)
        results = list(pool.map(one, draws))
        oc = fitted.result()
    prepared[0].unpersist()
    prepared[1].unpersist()
    trials = []
    best = None
    for (arch, lr, wd), (model, val_mse, hist) in zip(draws, results):
        trials.append({"h1": arch[0], "h2": arch[1], "h3": arch[2], "lr": lr, "weight_decay": wd,
                       "best_val_mse_mean": val_mse, "epochs_run": len(hist)})
        if best is None or val_mse < best[1]:
            best = (model, val_mse)
    st.ae_trials = trials
    st.oc_model = oc
    st.ae_model = best[0]
    ml, dl = oc.scorer(scaled), best[0].scorer(scaled)

    def both():
        parts = ml(), dl()
        return lambda x: np.hstack([of(x) for of in parts])

    names = oc.out_cols("ml_raw")
    out = with_scores(scaled, cols, [*names, "ae"], both)       # one pass over Python
    return out.select("row_id", "y", "family", "split", *names, "ae", *cols)
