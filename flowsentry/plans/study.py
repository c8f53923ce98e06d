"""End-to-end study over one flow frame: preprocessing, two detectors,
sweeps, fusion calibration and ablation.

The detector scores are computed once into a ``scored`` table (row_id, y,
family, split, scores; parquet, partitioned by split, so a reader of
validation scores reads these alone).  Every one-class and threshold
candidate, of sweeps and report tables alike, is counted by one scan of it
into the ``cube``, a table of (candidates x (families + 1)) rows that sweeps
and reports read; the ablation and the fusion candidates, which hang on its
result, take one scan each.  Only fitted statistics (p-sized vectors, a
handful of thresholds and family names) are collected to the driver.

Two detector families plug in through ``Detectors``:
* ``simple``  (default for oracle checks): ML = zmax with a ν boundary,
  DL = zsq (mean z^2);
* ``learned``: ML = random-Fourier one-class SVM, DL = autoencoder MSE.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import flag_ge, flag_gt, robust_z, weighted_sum
from ..operators import metrics as M
from ..operators import quantiles as Q
from ..operators.detectors.simple import QuantileBoundary, fit_boundaries, zmax, zsq
from ..operators.preprocess import Preprocessor, fit_preprocess
from ..session import cut_lineage, shared_path
from ..operators.sampling import (AE_LINE_THRESHOLDS, AE_TABLE_THRESHOLDS, AE_THR_QUANTILES, FUSION_Q, PAPER_MSE_THRESHOLDS, SEED,
                                  SVM_NU_VALUES, assign_split, attack_families, family_column, fusion_weight_grid,
                                  split_families, threshold_grid)

ROBUST_EPS = 1e-9


def nu_name(nu: float) -> str:
    return f"nu={nu}"


def thr_name(t: float) -> str:
    return f"thr={t}"


def first_best(rows: list, key: str, maximize: bool = True):
    """Strict comparison, so ties keep the earliest candidate."""
    best = None
    for r in rows:
        v = r[key]
        if v is None:
            continue
        if best is None or (v > best[key] if maximize else v < best[key]):
            best = r
    return best


ABLATION_MODELS = ("ML_only_OC_SVM", "DL_only_AE", "Hybrid_fusion")


@dataclass
class Study:
    """``learned_options`` (detectors="learned"): ``rff_components`` (512),
    ``oc_fit_rows`` (None = all benign train rows; an int caps the one-class
    fit by md5 rank), ``oc_tol`` (0.01: objective gap at which a ν's solver
    stops), ``oc_rounds`` (100 at most), ``ae_trials`` (2), ``ae_epochs`` (8),
    ``slots`` (8: workers that rows are dealt to in training).

    ``scorers`` (U2, detectors="custom"): {"ml": f, "ae": g} where each
    function maps the list of scaled feature column names to a score Column
    (any built-in expression or a pandas UDF over those columns); higher
    means more anomalous."""
    flows: DataFrame
    features: list[str]
    seed: int = SEED
    detectors: str = "simple"
    nus: tuple[float, ...] = SVM_NU_VALUES
    calib_fraction: float = 0.5
    selection_families: str = "all"   # reference behaviour; or "calibration"
    learned_options: dict = field(default_factory=dict)
    scorers: dict | None = None

    # ------------------------------------------------------------ fitting
    cache_flows: bool = True

    @cached_property
    def base(self) -> DataFrame:
        """The narrow working set (key, label, family, features, split),
        written once as a table in the shared folder, so the fit passes and
        scoring do not re-derive the flow view or hash the keys anew.  Not a
        cache: its partitions would take the memory of the aggregates, and be
        evicted and read whole where they do not fit."""
        cols = ["row_id", "y", *{self.family_col, "attack_family"}, *self.features]
        df = assign_split(self.flows.select(*cols), self.features, self.seed)
        if not self.cache_flows:
            return df
        path = shared_path(df.sparkSession, "flows")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    @cached_property
    def _fit(self) -> tuple[Preprocessor, DataFrame]:
        return fit_preprocess(self.base, self.features, seed=self.seed, has_split=True)

    @property
    def prep(self) -> Preprocessor:
        return self._fit[0]

    @property
    def split_frame(self) -> DataFrame:
        return self._fit[1]

    @cached_property
    def family_col(self) -> str:
        return family_column(self.flows)

    @cached_property
    def scaled(self) -> DataFrame:
        """Rows that take part in fitting or evaluation, scaled (z_ columns)."""
        keep = self.split_frame.where((F.col("y") == 1) | F.col("split").isNotNull())
        cols = ["row_id", "y", F.col(self.family_col).alias("family"), "split"]
        return self.prep.transform(keep, prefix="z_").select(
            *cols, *[f"z_{f}" for f in self.prep.features])

    @cached_property
    def zcols(self) -> list[str]:
        return [f"z_{f}" for f in self.prep.features]

    @cached_property
    def scored(self) -> DataFrame:
        """row_id, y, family, split, z columns, ml_raw, ae (persisted once)."""
        if self.detectors == "learned":
            from ..operators.detectors.learned import learned_scores
            out = learned_scores(self)
        elif self.detectors == "custom":
            out = self.scaled.select("row_id", "y", "family", "split", *self.zcols,
                                     self.scorers["ml"](self.zcols).alias("ml_raw"),
                                     self.scorers["ae"](self.zcols).alias("ae"))
        else:
            out = self.scaled.select("row_id", "y", "family", "split", *self.zcols,
                                     zmax(self.zcols).alias("ml_raw"), zsq(self.zcols).alias("ae"))
        # a table in the shared folder: every sweep then plans against a short
        # lineage and reads its own columns and split, and a lost executor
        # costs a re-read, not a re-fit
        path = shared_path(out.sparkSession, "scored")
        out.write.partitionBy("split").parquet(path)
        schema = T.StructType([f for f in out.schema if f.name != "split"] + [f for f in out.schema if f.name == "split"])
        return out.sparkSession.read.schema(schema).parquet(path)

    @cached_property
    def counts(self) -> dict:
        """Benign split sizes, known from the fit (no extra job)."""
        return {"train": self.prep.n_train, "val": self.prep.n_val}

    # ------------------------------------------------------------ ML side
    @cached_property
    def boundary(self):
        """ν boundaries: (1-ν) quantile of the benign-train ML scores, so a
        share ν of training rows is flagged (the one-class ν-property)."""
        train = self.scored.where(F.col("split") == "train")
        if "ml_raw" in self.scored.columns:
            return fit_boundaries(train, "ml_raw", self.nus)
        # one score column per ν (refined one-class model): boundary k from column k
        names = [self.ml_col(nu) for nu in self.nus]
        qs = Q.quantiles(train, names, [1.0 - nu for nu in self.nus])
        return QuantileBoundary(tuple(self.nus), tuple(float(qs[c][k]) for k, c in enumerate(names)))

    def ml_col(self, nu: float) -> str:
        """The ML score column for ν: shared, or ``ml_raw_k`` for per-ν models."""
        return "ml_raw" if "ml_raw" in self.scored.columns else f"ml_raw_{self.nus.index(nu)}"

    def ml_decision(self, nu: float) -> Column:
        return self.boundary.decision(self.ml_col(nu), nu)

    def nu_preds(self) -> dict:
        return {nu_name(nu): flag_gt(self.ml_decision(nu), 0.0) for nu in self.nus}

    # ------------------------------------------------------------ all candidates
    @cached_property
    def cube(self) -> DataFrame:
        """Counts of every (candidate, family), and of benign validation rows
        alone (family null): one scan of the scores.  Candidates are the nus,
        the threshold grid and the thresholds of the report tables."""
        from ..operators.reports import OPERATING_POINTS
        thresholds = {*self.thr_grid, *AE_TABLE_THRESHOLDS, *AE_LINE_THRESHOLDS, *(t for _, t in OPERATING_POINTS)}
        preds = {**self.nu_preds(), **self.thr_preds(sorted(thresholds))}
        return cut_lineage(M.fold_counts(self.scored, preds, "family", benign_row=True))

    def metrics_of(self, candidates, families: list[str] | None = None) -> DataFrame:
        """Per (candidate, family) metrics out of the cube, without AUC."""
        rows = self.cube.where(F.col("candidate").isin(list(candidates)) & F.col("family").isNotNull())
        if families is not None:
            rows = rows.where(F.col("family").isin(list(families)))
        return M.metrics_from_counts(rows).withColumn("roc_auc", F.lit(None).cast("double"))

    def acceptance_of(self, candidates) -> DataFrame:
        """(candidate, benign_accuracy) out of the cube."""
        return M.acceptance(self.cube.where(F.col("candidate").isin(list(candidates))))

    @cached_property
    def nu_metrics(self) -> DataFrame:
        """per (ν, family) metrics (no AUC: the selection needs macro-F1
        only; ``nu_metrics_auc`` adds it).  Over all families: the selection
        scope chooses ν, it never cuts a report."""
        return self.metrics_of([nu_name(nu) for nu in self.nus])

    @cached_property
    def nu_metrics_auc(self) -> DataFrame:
        auc = M.fold_auc(self.scored, {nu_name(nu): self.ml_decision(nu) for nu in self.nus}, "family")
        return self.nu_metrics.drop("roc_auc").join(auc, ["candidate", "family"], "left")

    @cached_property
    def _sweep_summary(self) -> tuple[dict, dict]:
        """macro-F1 over the selection scope, and benign acceptance, of every ν
        and every AE threshold."""
        names = [*map(nu_name, self.nus), *map(thr_name, self.thr_grid)]
        macro = M.macro_f1(self.metrics_of(names, self.selection_scope())).collect()
        return ({r["candidate"]: r["macro_f1"] for r in macro},
                {r["candidate"]: r["benign_accuracy"] for r in self.acceptance_of(names).collect()})

    @cached_property
    def nu_summary(self) -> list:
        """macro-F1 (0 without a family) and benign acceptance per ν."""
        macro, accepted = self._sweep_summary
        return [{"nu": nu, "candidate": nu_name(nu), "macro_f1": macro.get(nu_name(nu), 0.0),
                 "benign_val_accuracy": accepted.get(nu_name(nu))} for nu in self.nus]

    @cached_property
    def best_nu(self) -> float:
        return first_best(self.nu_summary, "macro_f1")["nu"]

    # ------------------------------------------------------------ DL side
    @cached_property
    def ae_val_quantiles(self) -> list[float]:
        val = self.scored.where(F.col("split") == "val")
        return Q.quantiles(val, ["ae"], list(AE_THR_QUANTILES))["ae"]

    @cached_property
    def thr_grid(self) -> list[float]:
        return threshold_grid(PAPER_MSE_THRESHOLDS, [v for v in self.ae_val_quantiles if v is not None])

    def thr_preds(self, thresholds) -> dict:
        return {thr_name(t): flag_gt("ae", t) for t in thresholds}

    @cached_property
    def thr_metrics(self) -> DataFrame:
        """every threshold of the grid, over the selection scope."""
        return self.metrics_of([thr_name(t) for t in self.thr_grid], self.selection_scope())

    @cached_property
    def thr_summary(self) -> list:
        macro, _ = self._sweep_summary
        return [{"threshold": t, "candidate": thr_name(t), "macro_f1": macro.get(thr_name(t), 0.0)}
                for t in self.thr_grid]

    @cached_property
    def best_thr(self) -> float:
        return first_best(self.thr_summary, "macro_f1")["threshold"]

    # ------------------------------------------------------------ fusion
    @cached_property
    def families(self) -> list[str]:
        return attack_families(self.scored, "family")

    @cached_property
    def family_roles(self) -> tuple[list[str], list[str]]:
        return split_families(self.families, self.seed, self.calib_fraction)

    @cached_property
    def robust_refs(self) -> dict:
        """Median and MAD(+1e-9) of both scores over benign validation."""
        val = self.scored.where(F.col("split") == "val").select(
            self.ml_decision(self.best_nu).alias("svm"), F.col("ae"))
        med = Q.quantiles(val, ["svm", "ae"], [0.5])
        ms, ma = med["svm"][0], med["ae"][0]
        dev = val.select(F.abs(F.col("svm") - F.lit(ms)).alias("svm"), F.abs(F.col("ae") - F.lit(ma)).alias("ae"))
        mad = Q.quantiles(dev, ["svm", "ae"], [0.5])
        return {"svm": (ms, mad["svm"][0] + ROBUST_EPS), "ae": (ma, mad["ae"][0] + ROBUST_EPS)}

    def z_svm(self) -> Column:
        m, d = self.robust_refs["svm"]
        return robust_z(self.ml_decision(self.best_nu), m, d)

    def z_ae(self) -> Column:
        m, d = self.robust_refs["ae"]
        return robust_z("ae", m, d)

    def fused(self, w_svm: float, w_ae: float) -> Column:
        return weighted_sum([self.z_svm(), self.z_ae()], [w_svm, w_ae])

    @cached_property
    def weight_grid(self) -> list[tuple[float, float]]:
        return fusion_weight_grid()

    @cached_property
    def fusion_thresholds(self) -> dict:
        """quantile .92 of every candidate's fused benign-val score, one agg."""
        val = self.scored.where(F.col("split") == "val").select(
            *[self.fused(ws, wa).alias(f"f{i}") for i, (ws, wa) in enumerate(self.weight_grid)])
        qs = list(FUSION_Q)
        res = Q.quantiles(val, [f"f{i}" for i in range(len(self.weight_grid))], qs)
        return {(i, q): res[f"f{i}"][k] for i in range(len(self.weight_grid)) for k, q in enumerate(qs)}

    def fusion_candidates(self) -> list[dict]:
        out = []
        for i, (ws, wa) in enumerate(self.weight_grid):
            for q in FUSION_Q:
                out.append({"candidate": f"w_svm={ws}|q={q}", "w_svm": ws, "w_ae": wa,
                            "thr_quantile": q, "thr": self.fusion_thresholds[(i, q)]})
        return out

    @cached_property
    def fusion_metrics(self) -> DataFrame:
        cal, _ = self.family_roles
        preds = {c["candidate"]: flag_gt(self.fused(c["w_svm"], c["w_ae"]), c["thr"])
                 for c in self.fusion_candidates() if c["thr"] is not None}
        return M.fold_metrics(self.scored, preds, "family", families=cal)

    @cached_property
    def fusion_summary(self) -> list:
        mf = {r["candidate"]: r["macro_f1"] for r in
              M.mean_fold(self.fusion_metrics).collect()}
        out = []
        for c in self.fusion_candidates():
            if c["candidate"] in mf and self.family_roles[0]:
                out.append({**c, "macro_f1_calib": mf[c["candidate"]]})
        return out

    @cached_property
    def best_fusion(self) -> dict:
        return first_best(self.fusion_summary, "macro_f1_calib")

    def deploy_columns(self) -> dict:
        """fused z and prediction with the calibrated config."""
        b = self.best_fusion
        z = self.fused(b["w_svm"], b["w_ae"])
        return {"z": z, "pred": flag_gt(z, b["thr"])}

    # ------------------------------------------------------------ ablation
    @cached_property
    def ablation_metrics(self) -> DataFrame:
        """F14 rows: (candidate=model, family, metrics) on the test families."""
        _, test = self.family_roles
        b = self.best_fusion
        fused = self.fused(b["w_svm"], b["w_ae"])
        preds = {
            "ML_only_OC_SVM": flag_ge(self.ml_decision(self.best_nu), 0.0),   # predict = -1 holds at 0 too
            "DL_only_AE": flag_gt("ae", self.best_thr),
            "Hybrid_fusion": flag_gt(fused, b["thr"]),
        }
        scores = {"DL_only_AE": F.col("ae"), "Hybrid_fusion": fused}
        return M.fold_metrics(self.scored, preds, "family", families=test, scores=scores)

    def ablation_summary(self) -> DataFrame:
        return M.mean_fold(self.ablation_metrics, candidates=ABLATION_MODELS).withColumnRenamed("candidate", "model")

    def selection_scope(self) -> list[str] | None:
        return self.family_roles[0] if self.selection_families == "calibration" else None
