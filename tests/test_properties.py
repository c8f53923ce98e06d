"""Property tests: partition independence, fusion invariance, workflows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import metrics as M


def _scored(spark, seed=5, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((f"b{i}", 0, "Benign (Validation)", "val", float(rng.normal()), float(rng.normal())))
    for f, shift in (("A", 1.0), ("B", 0.3)):
        for i in range(n // 4):
            rows.append((f"{f}{i}", 1, f, None, float(rng.normal() + shift), float(rng.normal() + shift)))
    return spark.createDataFrame(rows, "row_id string, y int, family string, split string, s1 double, s2 double")


def _collect(df):
    return sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_metrics_independent_of_partitioning(spark):
    df = _scored(spark)
    preds = {"p": F.col("s1") > 0.5}
    scores = {"p": F.col("s1")}
    a = M.fold_metrics(df, preds, "family", scores=scores)
    b = M.fold_metrics(df.repartition(13, "row_id"), preds, "family", scores=scores)
    assert _collect(a) == _collect(b)


def test_auc_invariant_under_positive_affine_maps(spark):
    df = _scored(spark)
    a = {r["family"]: r["roc_auc"] for r in M.fold_auc(df, {"x": F.col("s1")}, "family").collect()}
    b = {r["family"]: r["roc_auc"] for r in M.fold_auc(df, {"x": F.col("s1") * 3.5 + 7}, "family").collect()}
    assert a == pytest.approx(b)


def test_fused_decision_invariant_under_affine_score_changes(spark):
    """robust z removes location/scale, so fused decisions do not change."""
    from flowsentry.functions.expr import robust_z, weighted_sum
    from flowsentry.operators import quantiles as Q
    df = _scored(spark)

    def decisions(c1, c2):
        val = df.where("split = 'val'").select(c1.alias("a"), c2.alias("b"))
        med = Q.quantiles(val, ["a", "b"], [0.5])
        dev = val.select(F.abs(F.col("a") - med["a"][0]).alias("a"), F.abs(F.col("b") - med["b"][0]).alias("b"))
        mad = Q.quantiles(dev, ["a", "b"], [0.5])
        z = weighted_sum([robust_z(c1, med["a"][0], mad["a"][0] + 1e-9),
                          robust_z(c2, med["b"][0], mad["b"][0] + 1e-9)], [0.25, 0.75])
        return [r[0] for r in df.orderBy("row_id").select((z > 1.0).cast("int")).collect()]

    base = decisions(F.col("s1"), F.col("s2"))
    moved = decisions(F.col("s1") * 4.0 - 2.0, F.col("s2") * 0.5 + 10.0)
    assert base == moved


def test_hybrid_workflow_expression_detectors(spark):
    from flowsentry.plans.runs import run_hybrid
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    from tests.conftest import SF_SMALL
    res = run_hybrid(lineitem_flows(spark, SF_SMALL), LINEITEM_FEATURES, detectors="simple",
                     selection_families="calibration")
    rows = res.tables["ablation_summary"].collect()
    assert {r["model"] for r in rows} == {"ML_only_OC_SVM", "DL_only_AE", "Hybrid_fusion"}
    for r in rows:
        assert r["macro_f1"] == pytest.approx(r["mean_fold_f1_macro"])
        assert r["mean_fold_fallout_fpr"] == pytest.approx(1 - r["mean_fold_specificity"])


def test_classical_and_deep_workflows(spark):
    from flowsentry.plans.runs import run_classical, run_deep
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    from tests.conftest import SF_SMALL
    opts = {"rff_components": 64, "ae_epochs": 2, "ae_trials": 1}
    flows = lineitem_flows(spark, SF_SMALL)
    c = run_classical(flows, LINEITEM_FEATURES, **opts)
    assert c.tables["svm_search"].count() == 3
    assert c.tables["iforest_per_family"].count() == c.tables["svm_per_family"].count() > 0
    d = run_deep(flows, LINEITEM_FEATURES, **opts)
    assert d.tables["ae_trials"].count() == 1
    assert d.tables["per_family_best"].count() > 0


def test_user_scorers_plug_in(spark):
    """A pandas UDF and a plain expression as the two detectors."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from flowsentry.plans.study import Study
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    from tests.conftest import SF_SMALL

    @pandas_udf("double")
    def l1(*cols: pd.Series) -> pd.Series:
        return sum(c.abs() for c in cols)

    st = Study(lineitem_flows(spark, SF_SMALL), LINEITEM_FEATURES, detectors="custom",
               scorers={"ml": lambda zc: l1(*[F.col(c) for c in zc]),
                        "ae": lambda zc: F.greatest(*[F.abs(F.col(c)) for c in zc])})
    rows = st.ablation_summary().collect()
    assert len(rows) == 3
    train = st.scored.where("split = 'train'")
    share = train.select(F.avg((st.ml_decision(0.2) > 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.2, abs=0.01)
