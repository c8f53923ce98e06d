"""The three end-to-end workflows as library calls.

Each takes a flow frame (from ``sources.flow_csv.read_flow_csv`` or any
binding), fits on the cluster, and returns small result frames; with
``out_dir`` it also writes the model bundle (A6-A13) there (``budget``: the
data budget, noted in its configuration).  The flow frame
may come from a quota sample (``operators.sampling.quota_sample``) to mirror
the reference's row budget, or be the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag_ge
from ..operators import metrics as M
from ..operators import quantiles as Q
from ..operators.detectors import iforest as IF
from ..session import cut_lineage
from ..sources.artifacts import write_bundle
from .study import Study, thr_name

IFOREST_QUANTILE = 0.95  # fixed value: isolation-forest threshold = benign-val 0.95 quantile, flag >=


@dataclass
class RunResult:
    study: Study
    tables: dict[str, DataFrame]


def run_classical(flows: DataFrame, features: list[str], out_dir: str | None = None,
                  run_iforest: bool = True, seed: int = 42, budget=None, **options) -> RunResult:
    """One-class ν sweep (best by macro-F1, first wins) + isolation forest."""
    st = Study(flows, features, seed=seed, detectors="learned", learned_options=options)
    tables = {
        "svm_search": M.summarize(st.nu_metrics),
        "svm_per_family": st.nu_metrics_auc.where(F.col("candidate") == f"nu={st.best_nu}"),
    }
    forest = None
    if run_iforest:
        train = st.scored.where(F.col("split") == "train")
        model = IF.fit(train, st.zcols, n_rows=st.counts.get("train"), seed=seed)
        # written once: the quantile, the counts and the AUC read the scores, not the trees
        scored = cut_lineage(model.score(st.scored.select("row_id", "y", "family", "split", *st.zcols), "if_score")
                             .select("row_id", "y", "family", "split", "if_score"))
        thr = Q.quantiles(scored.where(F.col("split") == "val"), ["if_score"], [IFOREST_QUANTILE])["if_score"][0]
        tables["iforest_per_family"] = M.fold_metrics(
            scored, {"iforest": flag_ge("if_score", thr)}, "family", scores={"iforest": F.col("if_score")})
        forest = (model, thr)
    if out_dir:
        write_bundle(flows.sparkSession, out_dir, st, budget, forest, tables.get("iforest_per_family"))
    return RunResult(st, tables)


def run_deep(flows: DataFrame, features: list[str], out_dir: str | None = None, seed: int = 42, budget=None,
             **options) -> RunResult:
    """Autoencoder random search, threshold sweep, best-threshold families."""
    st = Study(flows, features, seed=seed, detectors="learned", learned_options=options)
    best = st.thr_metrics.where(F.col("candidate") == thr_name(st.best_thr))
    tables = {
        "ae_trials": flows.sparkSession.createDataFrame(
            st.ae_trials, "h1 int, h2 int, h3 int, lr double, weight_decay double, "
                          "best_val_mse_mean double, epochs_run int"),
        "threshold_grid": M.summarize(st.thr_metrics),
        "per_family_best": best,
    }
    if out_dir:
        write_bundle(flows.sparkSession, out_dir, st, budget)
    return RunResult(st, tables)


def run_hybrid(flows: DataFrame, features: list[str], out_dir: str | None = None, seed: int = 42,
               detectors: str = "learned", selection_families: str = "all", budget=None, **options) -> RunResult:
    """Both detectors, fusion calibration on calibration families, ablation on
    the held-out families."""
    st = Study(flows, features, seed=seed, detectors=detectors, selection_families=selection_families,
               learned_options=options)
    tables = {
        "fusion_calibration": flows.sparkSession.createDataFrame(
            [(c["w_svm"], c["w_ae"], c["thr_quantile"], c["thr"], c["macro_f1_calib"])
             for c in st.fusion_summary],
            "w_svm double, w_ae double, thr_quantile double, thr double, macro_f1_calib double"),
        "ablation_summary": st.ablation_summary(),
        "ablation_per_family": st.ablation_metrics,
    }
    if out_dir:
        write_bundle(flows.sparkSession, out_dir, st, budget)
    return RunResult(st, tables)
