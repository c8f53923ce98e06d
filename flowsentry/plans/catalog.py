"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator
group of the inventory.  Every query reads the given tables (whole tables,
no id subsets) and returns a small, aliased result whose columns match the
DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import flag_gt, recon_mse
from ..operators import metrics as M
from ..operators import quantiles as Q
from ..operators import reports as R
from ..operators import sampling as S
from ..operators.preprocess import correlation_frame
from ..sources.tables import (LINEITEM_FEATURES, embedding_flows, event_flows, lineitem_flows)
from .study import Study, thr_name

DP = 6  # results are rounded to 6 dp on both sides of the oracle check
METRIC_OUT = ["accuracy", "precision", "recall", "f1_binary", "f1_macro", "fallout_fpr",
              "specificity", "roc_auc"]


def _r(c, dp: int = DP):
    return F.round(F.col(c) if isinstance(c, str) else c, dp)


_STUDIES: dict = {}


def study(spark: SparkSession, sf_dir: str, detectors: str = "simple") -> Study:
    """One fitted study per (sf_dir, detectors) and session; queries share it."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, detectors)
    if key not in _STUDIES:
        _STUDIES[key] = Study(lineitem_flows(spark, sf_dir), LINEITEM_FEATURES, detectors=detectors)
    return _STUDIES[key]


def _metric_frame(m: DataFrame, extra: list[str] = ()) -> DataFrame:
    return m.select(*extra, "family", "n_benign", "n_attack", "tp", "fp", "tn", "fn",
                    *[_r(c).alias(c) for c in METRIC_OUT])


# ---------------------------------------------------------------- labels
def q_label_binary(spark, sf_dir):
    ev = event_flows(spark, sf_dir)
    return ev.select("row_id", "cic_label", F.col("y").cast("int").alias("y"), "attack_family", "report_name")


def q_family_counts(spark, sf_dir):
    ev = event_flows(spark, sf_dir)
    return ev.groupBy("attack_family", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def q_report_name_counts(spark, sf_dir):
    ev = event_flows(spark, sf_dir)
    return ev.groupBy("report_name").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(F.col("y").cast("int")).alias("n_attack"))


# ---------------------------------------------------------------- cleaning
def q_clean_nonfinite(spark, sf_dir):
    lf = lineitem_flows(spark, sf_dir)
    cols = LINEITEM_FEATURES
    stacked = lf.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])).alias("s"))
    return stacked.groupBy(F.col("s.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("s.x").isNull().cast("int")).alias("n_missing"),
        _r(F.sum("s.x"), 2).alias("total"))


def q_drop_missing_benign(spark, sf_dir):
    lf = S.assign_split(lineitem_flows(spark, sf_dir), LINEITEM_FEATURES)
    return lf.groupBy(F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.count("split").alias("n_complete_benign"))


def q_row_counts(spark, sf_dir):
    """Rows loaded, benign, benign kept after dropping incomplete rows,
    train and validation, in one conditional aggregate."""
    lf = S.assign_split(lineitem_flows(spark, sf_dir), LINEITEM_FEATURES)
    return lf.agg(F.count(F.lit(1)).alias("loaded"),
                  F.count_if(F.col("y") == 0).alias("benign"),
                  F.count("split").alias("benign_complete"),
                  F.count_if(F.col("split") == "train").alias("train"),
                  F.count_if(F.col("split") == "val").alias("val"))


# ---------------------------------------------------------------- sampling
QUOTA_TOTAL = 20_000
QUOTA_BENIGN_FRACTION = 0.65


def q_quota_sample(spark, sf_dir):
    lf = lineitem_flows(spark, sf_dir)
    s = S.quota_sample(lf, QUOTA_TOTAL, QUOTA_BENIGN_FRACTION, seed=S.SEED)
    return s.select("row_id", "src_file", F.col("y").cast("int").alias("y"))


def q_quota_sample_repeats(spark, sf_dir):
    """D1 with ids that repeat hundreds of times: exact sizes per file and class."""
    lf = lineitem_flows(spark, sf_dir).withColumn("row_id", F.concat_ws("-", "cic_label", F.col("qty").cast("string")))
    s = S.quota_sample(lf, QUOTA_TOTAL, QUOTA_BENIGN_FRACTION, seed=S.SEED)
    return s.groupBy("src_file", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def q_train_val_split(spark, sf_dir):
    lf = S.assign_split(lineitem_flows(spark, sf_dir), LINEITEM_FEATURES)
    return lf.where(F.col("split").isNotNull()).select("row_id", "split")


FIT_SAMPLE_ROWS = 10_000


def q_fit_sample_topk(spark, sf_dir):
    lf = S.assign_split(lineitem_flows(spark, sf_dir), LINEITEM_FEATURES)
    return S.fit_sample(lf.where(F.col("split") == "train"), FIT_SAMPLE_ROWS).select("row_id")


def q_calib_test_families(spark, sf_dir):
    """D5 + H3/J6: calibration families from the seeded permutation; the test
    families are the set difference (left anti join against calibration)."""
    st = study(spark, sf_dir)
    cal, _ = st.family_roles
    fams = st.scored.where(F.col("y") == 1).groupBy("family").agg(F.count(F.lit(1)).alias("n_attack"))
    cal_df = F.broadcast(spark.createDataFrame([(f,) for f in cal], "family string"))
    calib = fams.join(cal_df, "family", "left_semi").withColumn("role", F.lit("calibration"))
    test = fams.join(cal_df, "family", "left_anti").withColumn("role", F.lit("test"))
    return calib.unionByName(test)


# ---------------------------------------------------------------- preprocessing
def q_preprocess_fit(spark, sf_dir):
    st = study(spark, sf_dir)
    fr = st.prep.to_frame(spark)
    return fr.select("feature", "kept", _r("median").alias("median"), _r("mean").alias("mean"),
                     _r("std").alias("std"))


def q_corr_matrix(spark, sf_dir):
    """Pearson r of every candidate pair on the benign train rows (the
    study's fitted Gramian; ``correlation_matrix`` computes it standalone)."""
    prep = study(spark, sf_dir).prep
    corr = np.array([[np.nan if v is None else v for v in row] for row in prep.corr])
    return correlation_frame(spark, prep.candidates, corr).select("a", "b", _r("r").alias("r"))


def q_corr_prune(spark, sf_dir):
    """Which candidate features the greedy upper-triangle rule drops."""
    prep = study(spark, sf_dir).prep
    rows = [(f, f in prep.dropped) for f in prep.candidates]
    return spark.createDataFrame(rows, "feature string, dropped boolean")


def q_fit_medians(spark, sf_dir):
    """Median of every kept feature over the benign train rows."""
    prep = study(spark, sf_dir).prep
    return spark.createDataFrame(list(zip(prep.features, prep.medians)), "feature string, median double").select(
        "feature", _r("median").alias("median"))


def q_fit_scaler(spark, sf_dir):
    """Mean and population std (scale 1 for constant columns)."""
    prep = study(spark, sf_dir).prep
    rows = list(zip(prep.features, prep.means, prep.stds, prep.scales))
    return spark.createDataFrame(rows, "feature string, mean double, std double, scale double").select(
        "feature", _r("mean").alias("mean"), _r("std").alias("std"), _r("scale").alias("scale"))


def q_reindex_impute(spark, sf_dir):
    """B6 + B7: a frame that lacks one fitted feature (``tax``) and carries an
    extra column is reindexed to the fitted list; absent and missing values
    take the fitted medians."""
    from ..functions.expr import impute, reindex
    prep = study(spark, sf_dir).prep
    other = lineitem_flows(spark, sf_dir).drop("tax").withColumn("extra", F.lit(1.0))
    re = reindex(other, prep.features, keep=["row_id"])
    long = re.select("row_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), impute(f, m).alias("value"))
        for f, m in zip(prep.features, prep.medians)])).alias("s"))
    return long.select("row_id", "s.feature", _r("s.value").alias("value"))


def q_impute_scale(spark, sf_dir):
    st = study(spark, sf_dir)
    long = st.scaled.select("row_id", "split", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"z_{f}").alias("z")) for f in st.prep.features])).alias("s"))
    return long.select("row_id", "split", "s.feature", _r("s.z").alias("z"))


# ---------------------------------------------------------------- fold metrics
def _q95(st: Study) -> float:
    val = st.scored.where(F.col("split") == "val")
    return Q.quantiles(val, ["ae"], [0.95])["ae"][0]


def q_fold_confusion(spark, sf_dir):
    st = study(spark, sf_dir)
    c = M.fold_counts(st.scored, {"ae_q95": flag_gt("ae", _q95(st))}, "family")
    return c.select("family", "n_benign", "fp", "n_attack", "tp")


def q_fold_metrics(spark, sf_dir):
    st = study(spark, sf_dir)
    m = M.fold_metrics(st.scored, {"ae_q95": flag_gt("ae", _q95(st))}, "family",
                       scores={"ae_q95": F.col("ae")})
    return _metric_frame(m)


def q_fold_auc(spark, sf_dir):
    st = study(spark, sf_dir)
    a = M.fold_auc(st.scored, {"zsq": F.col("ae"), "zmax": F.col("ml_raw")}, "family")
    return a.select("candidate", "family", _r("roc_auc").alias("roc_auc"))


def q_macro_f1(spark, sf_dir):
    st = study(spark, sf_dir)
    return M.macro_f1(st.nu_metrics).select(
        F.regexp_extract("candidate", "nu=(.*)", 1).cast("double").alias("nu"), _r("macro_f1").alias("macro_f1"))


# ---------------------------------------------------------------- thresholds
def q_quantile_thresholds(spark, sf_dir):
    st = study(spark, sf_dir)
    val = st.scored.where(F.col("split") == "val")
    qs = [0.9, 0.92, 0.95]
    res = Q.quantiles(val, ["ae", "ml_raw"], qs)
    rows = [(col, q, res[col][i]) for col in ("ae", "ml_raw") for i, q in enumerate(qs)]
    return spark.createDataFrame(rows, "score string, q double, value double").select(
        "score", "q", _r("value").alias("value"))


def q_threshold_sweep(spark, sf_dir):
    st = study(spark, sf_dir)
    summ = M.summarize(st.thr_metrics)
    grid = spark.createDataFrame([(thr_name(t), t) for t in st.thr_grid], "candidate string, threshold double")
    return summ.join(grid, "candidate").select(
        "threshold", _r("macro_f1").alias("macro_f1"), _r("benign_accuracy").alias("benign_accuracy"))


def q_best_threshold(spark, sf_dir):
    st = study(spark, sf_dir)
    best = st.best_thr
    m = st.thr_metrics.where(F.col("candidate") == thr_name(best))
    return _metric_frame(m.withColumn("threshold", F.lit(best)), extra=["threshold"])


def q_ocsvm_nu_sweep(spark, sf_dir):
    """F4 with the expression detector: ν boundaries, macro-F1 and benign acceptance."""
    st = study(spark, sf_dir)
    rows = [(r["nu"], float(st.boundary.boundaries[i]), r["macro_f1"], r["benign_val_accuracy"])
            for i, r in enumerate(st.nu_summary)]
    return spark.createDataFrame(rows, "nu double, boundary double, macro_f1 double, benign_accuracy double").select(
        "nu", _r("boundary").alias("boundary"), _r("macro_f1").alias("macro_f1"),
        _r("benign_accuracy").alias("benign_accuracy"))


# ---------------------------------------------------------------- robust z / fusion
def q_robust_ref(spark, sf_dir):
    st = study(spark, sf_dir)
    rows = [(k, v[0], v[1]) for k, v in st.robust_refs.items()]
    return spark.createDataFrame(rows, "score string, median double, mad double").select(
        "score", _r("median").alias("median"), _r("mad").alias("mad"))


def q_fused_score(spark, sf_dir):
    st = study(spark, sf_dir)
    return st.scored.select("row_id", _r(st.z_svm()).alias("z_svm"), _r(st.z_ae()).alias("z_ae"),
                            _r(st.fused(0.5, 0.5)).alias("fused"))


def q_fusion_calibration(spark, sf_dir):
    st = study(spark, sf_dir)
    best = st.best_fusion
    rows = [(c["w_svm"], c["w_ae"], c["thr_quantile"], c["thr"], c["macro_f1_calib"], c is best)
            for c in st.fusion_summary]
    return spark.createDataFrame(
        rows, "w_svm double, w_ae double, thr_quantile double, thr double, macro_f1_calib double, chosen boolean"
    ).select("w_svm", "w_ae", "thr_quantile", _r("thr").alias("thr"),
             _r("macro_f1_calib").alias("macro_f1_calib"), "chosen")


def q_hybrid_deploy(spark, sf_dir):
    st = study(spark, sf_dir)
    d = st.deploy_columns()
    return st.scored.where((F.col("y") == 1) | (F.col("split") == "val")).select(
        "row_id", _r(d["z"]).alias("z"), d["pred"].cast("int").alias("pred"))


# ---------------------------------------------------------------- ablation
def q_ablation_summary(spark, sf_dir):
    st = study(spark, sf_dir)
    s = st.ablation_summary()
    return s.select("model", _r("macro_f1").alias("macro_f1"),
                    *[_r(f"mean_fold_{c}").alias(f"mean_fold_{c}") for c in M.METRIC_COLUMNS])


def q_ablation_delta(spark, sf_dir):
    st = study(spark, sf_dir)
    s = st.ablation_summary()
    mf = lambda m: F.max(F.when(F.col("model") == m, F.col("macro_f1")))
    return s.agg(_r(mf("Hybrid_fusion") - mf("ML_only_OC_SVM")).alias("hybrid_minus_ml"),
                 _r(mf("Hybrid_fusion") - mf("DL_only_AE")).alias("hybrid_minus_dl"),
                 _r(mf("ML_only_OC_SVM") - mf("DL_only_AE")).alias("ml_minus_dl"))


# ---------------------------------------------------------------- report tables
def q_table_class_by_nu(spark, sf_dir):
    st = study(spark, sf_dir)
    return R.class_by_nu_table(st)


def q_table3_acc(spark, sf_dir):
    return R.ae_table(study(spark, sf_dir), "accuracy")


def q_table3_f1(spark, sf_dir):
    return R.ae_table(study(spark, sf_dir), "f1_macro")


def q_accuracy_series(spark, sf_dir):
    return R.accuracy_series(study(spark, sf_dir))


def q_operating_points(spark, sf_dir):
    return R.operating_points(study(spark, sf_dir))


def q_topk_recall(spark, sf_dir):
    st = study(spark, sf_dir)
    m = st.thr_metrics.where(F.col("candidate") == thr_name(st.best_thr))
    return R.topk_by_recall(_metric_frame(m), 3)


# ---------------------------------------------------------------- sets
def q_flow_union(spark, sf_dir):
    a = lineitem_flows(spark, sf_dir).select("row_id", "src_file", "y", "report_name")
    b = event_flows(spark, sf_dir).select("row_id", "src_file", "y", "report_name")
    return a.unionByName(b).groupBy("src_file", "report_name").agg(F.count(F.lit(1)).alias("n"))


def q_class_universe(spark, sf_dir):
    a = lineitem_flows(spark, sf_dir).select(F.col("report_name").alias("class"))
    b = event_flows(spark, sf_dir).select(F.col("report_name").alias("class"))
    return a.union(b).distinct()


def q_val_membership(spark, sf_dir):
    """Rows of the flow table that belong to the validation split (semi join
    against the saved split membership)."""
    lf = lineitem_flows(spark, sf_dir)
    # distinct keys first: exact duplicate rows share a row_id, so a hot key
    # meets one build row instead of all its copies
    members = S.assign_split(lf, LINEITEM_FEATURES).where(F.col("split") == "val").select("row_id").distinct()
    return lf.join(members, "row_id", "left_semi").groupBy("report_name").agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- reconstruction error
def q_recon_error(spark, sf_dir):
    """B15 with the benign-train centroid as reconstruction x-hat."""
    em = S.assign_split(embedding_flows(spark, sf_dir), ["features"])
    dim = len(em.select("features").first()[0])
    cen = em.where(F.col("split") == "train").select(
        F.array(*[F.avg(F.col("features")[i]) for i in range(dim)]).alias("xhat"))
    scored = em.join(F.broadcast(cen), on=F.lit(True), how="left")
    return scored.select("row_id", F.col("y").cast("int").alias("y"), _r(recon_mse("features", "xhat")).alias("mse"))


Query = Callable[[SparkSession, str], DataFrame]


def sql_queries() -> dict[str, Query]:
    return {
        "label_binary": q_label_binary,
        "family_counts": q_family_counts,
        "report_name_counts": q_report_name_counts,
        "clean_nonfinite": q_clean_nonfinite,
        "drop_missing_benign": q_drop_missing_benign,
        "row_counts": q_row_counts,
        "quota_sample": q_quota_sample,
        "quota_sample_repeats": q_quota_sample_repeats,
        "train_val_split": q_train_val_split,
        "fit_sample_topk": q_fit_sample_topk,
        "calib_test_families": q_calib_test_families,
        "preprocess_fit": q_preprocess_fit,
        "corr_matrix": q_corr_matrix,
        "impute_scale": q_impute_scale,
        "corr_prune": q_corr_prune,
        "fit_medians": q_fit_medians,
        "fit_scaler": q_fit_scaler,
        "reindex_impute": q_reindex_impute,
        "fold_confusion": q_fold_confusion,
        "fold_metrics": q_fold_metrics,
        "fold_auc": q_fold_auc,
        "macro_f1": q_macro_f1,
        "quantile_thresholds": q_quantile_thresholds,
        "threshold_sweep": q_threshold_sweep,
        "best_threshold": q_best_threshold,
        "ocsvm_nu_sweep": q_ocsvm_nu_sweep,
        "robust_ref": q_robust_ref,
        "fused_score": q_fused_score,
        "fusion_calibration": q_fusion_calibration,
        "hybrid_deploy": q_hybrid_deploy,
        "ablation_summary": q_ablation_summary,
        "ablation_delta": q_ablation_delta,
        "table_class_by_nu": q_table_class_by_nu,
        "table3_acc": q_table3_acc,
        "table3_f1": q_table3_f1,
        "accuracy_series": q_accuracy_series,
        "operating_points": q_operating_points,
        "topk_recall": q_topk_recall,
        "flow_union": q_flow_union,
        "class_universe": q_class_universe,
        "val_membership": q_val_membership,
        "recon_error": q_recon_error,
    }


def all_queries() -> dict[str, Query]:
    out = dict(sql_queries())
    out.update(io_queries())
    from .learned_catalog import learned_queries
    from .literal_models import literal_queries
    return out | learned_queries() | literal_queries()


# ---------------------------------------------------------------- sources, sinks, stream
def q_csv_flow_scan(spark, sf_dir):
    """The dirty lineitem flows written as CSV capture files with
    padded headers plus a non-numeric column, then scanned (repeated headers:
    see the tests)."""
    from ..session import shared_path
    from ..sources.flow_csv import read_flow_csv
    src = lineitem_flows(spark, sf_dir, with_labels=False)
    out = shared_path(spark, "csv")
    padded = src.select(F.col("row_id").alias("Flow ID"), "src_file",
                        *[F.col(f).alias(f" {f} ") for f in LINEITEM_FEATURES],
                        F.lit(0.0).alias("Const"), F.col("Label").alias(" Label"))
    padded.write.partitionBy("src_file").option("header", True).csv(out)
    flows, feats = read_flow_csv(spark, out, files=None, check=False)
    return flows.groupBy("report_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("price").isNull().cast("int")).alias("n_price_missing"),
        _r(F.sum("price"), 2).alias("price_total"),
        F.lit(len(feats)).alias("n_features"))


def q_fusion_config(spark, sf_dir):
    from ..sources.artifacts import fusion_config_from_study
    cfg = fusion_config_from_study(study(spark, sf_dir))
    fr = cfg.to_frame(spark)
    refs = [_r(f"{s}_ref.{c}").alias(f"{s}_{c}") for s in ("svm", "ae") for c in ("median", "mad")]
    return fr.select(*[_r(c).alias(c) for c in ("w_svm", "w_ae", "thr", "thr_quantile")], *refs)


def q_bundle_manifest(spark, sf_dir):
    from ..session import shared_path
    from ..sources.artifacts import write_bundle
    return write_bundle(spark, shared_path(spark, "bundle"), study(spark, sf_dir))


def q_stream_score(spark, sf_dir):
    """The lineitem file arrives on a stream and is scored by the deploy
    configuration of the batch study (same projection as batch)."""
    from ..sources.artifacts import fusion_config_from_study
    from ..sources.tables import lineitem_flow_view, read_table
    from ..sources.artifacts import expression_scorer
    from ..streaming.score_stream import deploy, run_available
    st = study(spark, sf_dir)
    cfg = fusion_config_from_study(st)
    bnd = st.boundary.boundaries[st.boundary.nus.index(st.best_nu)]
    schema = read_table(spark, sf_dir, "lineitem").schema
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
           .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    stream = deploy(lineitem_flow_view(raw), expression_scorer(st.prep, bnd), cfg)
    path = run_available(spark, stream, "stream")
    return spark.read.parquet(path).select("row_id", _r("z").alias("z"), F.col("pred").cast("int").alias("pred"))


def q_stream_score_bundle(spark, sf_dir):
    """The study's bundle is written and read back; the flows arrive
    as CSV files under two headers, without labels, and are scored from it."""
    from ..session import shared_path
    from ..sources.artifacts import read_bundle, write_bundle
    from ..streaming.score_stream import score_csv_stream
    root = shared_path(spark, "stream-bundle")
    write_bundle(spark, f"{root}/bundle", study(spark, sf_dir))
    flows = lineitem_flows(spark, sf_dir, with_labels=False)
    late = F.col("src_file") >= "ship-1995"
    flows.where(~late).select(F.col("row_id").alias("Flow ID"), *LINEITEM_FEATURES).write.option("header", True).csv(f"{root}/in/a")
    flows.where(late).select(*[F.col(c).alias(f" {c} ") for c in reversed(LINEITEM_FEATURES)], F.lit("x").alias("Note"),
                             F.col("row_id").alias(" Flow ID")).write.option("header", True).csv(f"{root}/in/b")
    score_csv_stream(spark, f"{root}/in", read_bundle(spark, f"{root}/bundle"), f"{root}/out", f"{root}/_checkpoint",
                     key_col="Flow ID", files_per_batch=8).awaitTermination()
    out = spark.read.schema("row_id string, z double, pred byte").parquet(f"{root}/out")
    return out.select("row_id", _r("z").alias("z"), F.col("pred").cast("int").alias("pred"))


def io_queries() -> dict[str, Query]:
    return {
        "csv_flow_scan": q_csv_flow_scan,
        "fusion_config": q_fusion_config,
        "bundle_manifest": q_bundle_manifest,
        "stream_score": q_stream_score,
        "stream_score_bundle": q_stream_score_bundle,
    }
