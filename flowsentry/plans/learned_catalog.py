"""Queries over the learned detectors (no SQL oracle: iterative training).

They run on the whole lineitem flow view; correctness of the numerics is
covered by pytest (ν-property, separable fixtures, tree path lengths,
gradient checks) and these queries check shape and row counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import flag_ge, flag_gt
from ..operators import metrics as M
from ..operators import quantiles as Q
from ..operators.detectors import iforest as IF
from ..operators.detectors import pca as PC
from ..session import shared_path
from .catalog import _metric_frame, _r, study
from .runs import IFOREST_QUANTILE
from .study import thr_name


def q_ocsvm_sweep(spark, sf_dir):
    st = study(spark, sf_dir, "learned")
    rows = [(r["nu"], float(st.boundary.boundaries[i]), r["macro_f1"], r["benign_val_accuracy"])
            for i, r in enumerate(st.nu_summary)]
    return spark.createDataFrame(rows, "nu double, boundary double, macro_f1 double, benign_accuracy double")


def q_ocsvm_family_metrics(spark, sf_dir):
    st = study(spark, sf_dir, "learned")
    m = st.nu_metrics.where(F.col("candidate") == f"nu={st.best_nu}")
    return _metric_frame(m, extra=["candidate"])


def q_ae_search(spark, sf_dir):
    st = study(spark, sf_dir, "learned")
    _ = st.scored.columns
    return spark.createDataFrame(st.ae_trials,
                                 "h1 int, h2 int, h3 int, lr double, weight_decay double, "
                                 "best_val_mse_mean double, epochs_run int")


def q_ae_threshold(spark, sf_dir):
    st = study(spark, sf_dir, "learned")
    grid = spark.createDataFrame([(thr_name(t), t) for t in st.thr_grid], "candidate string, threshold double")
    mf = M.macro_f1(st.thr_metrics)
    return mf.join(grid, "candidate").select("threshold", _r("macro_f1").alias("macro_f1"))


def q_learned_ablation(spark, sf_dir):
    st = study(spark, sf_dir, "learned")
    s = st.ablation_summary()
    return s.select("model", _r("macro_f1").alias("macro_f1"),
                    *[_r(f"mean_fold_{c}").alias(f"mean_fold_{c}") for c in M.METRIC_COLUMNS])


def q_iforest_metrics(spark, sf_dir):
    st = study(spark, sf_dir)
    train = st.scored.where(F.col("split") == "train")
    forest = IF.fit(train, st.zcols, n_rows=st.counts.get("train"))
    scored = forest.score(st.scored.select("y", "family", "split", *st.zcols), "if_score")
    # a table in the shared folder: the threshold reads the validation scores alone
    path, scored = shared_path(spark, "iforest"), scored.select("y", "family", "split", "if_score")
    scored.write.parquet(path)
    scored = spark.read.schema(scored.schema).parquet(path)
    val = scored.where(F.col("split") == "val")
    thr = Q.quantiles(val, ["if_score"], [IFOREST_QUANTILE])["if_score"][0]
    m = M.fold_metrics(scored, {"iforest": flag_ge("if_score", thr)}, "family",
                       scores={"iforest": F.col("if_score")})
    return _metric_frame(m, extra=["candidate"])


def q_pca_recon(spark, sf_dir):
    st = study(spark, sf_dir)
    train = st.scored.where(F.col("split") == "train")
    axes = PC.fit_axes(train, st.zcols)
    scored = PC.with_recon_error(st.scored, st.zcols, axes, "pca").select("row_id", "y", "family", "split", "pca")
    val = scored.where(F.col("split") == "val")
    thr = Q.quantiles(val, ["pca"], [0.95])["pca"][0]
    m = M.fold_metrics(scored, {"pca_q95": flag_gt("pca", thr)}, "family", scores={"pca_q95": F.col("pca")})
    return _metric_frame(m, extra=["candidate"])


def learned_queries() -> dict:
    return {
        "ocsvm_sweep": q_ocsvm_sweep,
        "ocsvm_family_metrics": q_ocsvm_family_metrics,
        "ae_search": q_ae_search,
        "ae_threshold": q_ae_threshold,
        "learned_ablation": q_learned_ablation,
        "iforest_metrics": q_iforest_metrics,
        "pca_recon": q_pca_recon,
    }
