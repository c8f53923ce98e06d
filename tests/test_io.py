"""CSV capture scan (A1-A4), fusion config round trip (A9, F13), stream = batch."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowsentry.sources.artifacts import FusionConfig
from flowsentry.sources.flow_csv import CAPTURE_FILES, MissingCaptureFiles, MissingLabel, normalise_headers, read_flow_csv


def _write_captures(folder, drop=None):
    header = " Flow ID, Duration ,Const, Const,Pkts,Bytes,Label\n"
    for k, name in enumerate(CAPTURE_FILES):
        if name == drop:
            continue
        lines = [header]
        for i in range(20):
            label = "BENIGN" if (i % 4 or k == 0) else ["DoS Hulk", "PortScan", "Bot"][i % 3]
            if k == 1 and i == 3:
                label = ""
            dur = ["Infinity", "inf", "NaN", "", str(i * 1.5)][i % 5] if k == 2 else str(i * 1.5)
            lines.append(f"f{k}-{i},{dur},1,1,{i},{i * 10},{label}\n")
        with open(os.path.join(folder, name), "w") as fh:
            fh.writelines(lines)


def test_headers():
    assert normalise_headers([" a", "b ", "a", " a "]) == ["a", "b", "a__1", "a__2"]


def test_csv_scan(spark):
    folder = tempfile.mkdtemp(prefix="captures-")
    _write_captures(folder)
    flows, feats = read_flow_csv(spark, folder)
    assert feats == ["Duration", "Const", "Const__1", "Pkts", "Bytes"]  # 'Flow ID' is not numeric
    assert flows.count() == 160
    by = {r["src_file"]: r for r in flows.groupBy("src_file").agg(
        F.sum(F.col("Duration").isNull().cast("int")).alias("miss"), F.sum("y").alias("att")).collect()}
    assert by[CAPTURE_FILES[2]]["miss"] == 16  # Infinity, inf, NaN, empty -> missing
    assert by[CAPTURE_FILES[0]]["att"] == 0    # a file without attacks
    missing = flows.where(F.col("cic_label") == "nan").select("y", "attack_family").collect()
    assert [tuple(r) for r in missing] == [(1, "nan")]
    assert flows.select("row_id").distinct().count() == 160


def test_csv_align_by_name(spark):
    folder = tempfile.mkdtemp(prefix="captures-")
    names = ["a.csv", "b.csv"]
    with open(os.path.join(folder, names[0]), "w") as fh:
        fh.write("Pkts, Bytes ,Label\n1,10,BENIGN\n2,20,PortScan\n")
    with open(os.path.join(folder, names[1]), "w") as fh:
        fh.write("Bytes,Label,Pkts,Extra\n30,BENIGN,3,7\n40,Bot,4,8\n")
    flows, feats = read_flow_csv(spark, folder, files=names, align_by_name=True)
    assert set(feats) == {"Pkts", "Bytes", "Extra"}
    got = sorted((r["Pkts"], r["Bytes"], r["Extra"], r["report_name"]) for r in flows.collect())
    assert got == [(1.0, 10.0, None, "Benign (Validation)"), (2.0, 20.0, None, "PortScan"),
                   (3.0, 30.0, 7.0, "Benign (Validation)"), (4.0, 40.0, 8.0, "Botnet")]


def test_csv_swapped_columns_go_by_name(spark):
    folder = tempfile.mkdtemp(prefix="captures-")
    for name, text in {"a.csv": "Pkts,Bytes,Label\n1,10,BENIGN\n", "b.csv": "Bytes,Pkts,Label\n30,3,BENIGN\n",
                       "c.csv": "Pkts,Bytes,Label\n2,20,Bot\n", "empty.csv": ""}.items():
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(text)
    flows, feats = read_flow_csv(spark, folder, files=None)
    assert sorted(feats) == ["Bytes", "Pkts"]
    assert sorted((r["Pkts"], r["Bytes"], r["src_file"]) for r in flows.collect()) == [
        (1.0, 10.0, "a.csv"), (2.0, 20.0, "c.csv"), (3.0, 30.0, "b.csv")]


def test_csv_label_is_required(spark):
    folder = tempfile.mkdtemp(prefix="captures-")
    for name, text in {"a.csv": "Pkts,Bytes,Label\n1,10,BENIGN\n", "b.csv": "Pkts,Bytes\n2,20\n"}.items():
        with open(os.path.join(folder, name), "w") as fh:
            fh.write(text)
    with pytest.raises(MissingLabel, match="b.csv"):
        read_flow_csv(spark, folder, files=["a.csv", "b.csv"], check=False)


def test_csv_completeness(spark):
    folder = tempfile.mkdtemp(prefix="captures-")
    _write_captures(folder, drop=CAPTURE_FILES[5])
    with pytest.raises(MissingCaptureFiles):
        read_flow_csv(spark, folder)


REF = """{"w_svm": 0.25, "w_ae": 0.75, "thr": 6.359535158602902, "thr_quantile": 0.92,
 "svm_ref": {"median": -29.182877620689354, "mad": 5.581601507470598},
 "ae_ref": {"median": 0.03879103809595108, "mad": 0.031532273696495056}}"""


def test_fusion_config_round_trip_and_scoring(spark):
    cfg = FusionConfig.from_json(REF)
    assert FusionConfig.from_json(cfg.to_json()) == cfg
    rows = [(cfg.svm_median, cfg.ae_median), (cfg.svm_median, 0.3061), (cfg.svm_median, 0.3062),
            (112.80, cfg.ae_median), (112.81, cfg.ae_median)]
    df = spark.createDataFrame(rows, "svm double, ae double")
    z, pred = cfg.fused(F.col("svm"), F.col("ae"))
    out = df.select(z.alias("z"), pred.alias("p")).collect()
    assert out[0]["z"] == pytest.approx(0.0) and out[0]["p"] == 0
    assert [r["p"] for r in out[1:]] == [0, 1, 0, 1]


def test_stream_equals_batch(spark):
    from flowsentry.plans.catalog import q_hybrid_deploy, q_stream_score
    from tests.conftest import SF_SMALL
    stream = {r["row_id"]: (r["z"], r["pred"]) for r in q_stream_score(spark, SF_SMALL).collect()}
    batch = {r["row_id"]: (r["z"], r["pred"]) for r in q_hybrid_deploy(spark, SF_SMALL).collect()}
    assert batch and all(stream[k] == v for k, v in batch.items())


@pytest.fixture(scope="module")
def fitted(spark):
    from flowsentry.plans.study import Study
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    from tests.conftest import SF_SMALL
    return Study(lineitem_flows(spark, SF_SMALL), LINEITEM_FEATURES, detectors="learned",
                 learned_options={"rff_components": 32, "oc_tol": 0.05, "ae_epochs": 1, "ae_trials": 2})


def test_learned_bundle_round_trip(spark, fitted, tmp_path):
    """Write, read, score: the study's own scores, in batch and from CSV files
    that arrive under other headers and without labels."""
    from flowsentry.operators.detectors import iforest as IF
    from flowsentry.operators.sampling import data_budget
    from flowsentry.sources.artifacts import read_bundle, write_bundle
    from flowsentry.streaming.score_stream import deploy, score_csv_stream
    st, root = fitted, str(tmp_path / "bundle")
    train = st.scored.where("split = 'train'")
    forest = IF.fit(train, st.zcols, n_trees=5, psi=16)
    rows = st.nu_metrics.where(F.col("candidate") == f"nu={st.best_nu}").drop("candidate")
    manifest = {r["path"]: r["rows"] for r in write_bundle(spark, root, st, data_budget(), (forest, 0.5), rows).collect()}
    assert manifest["oc_model"] == 1 and manifest["run_config"] == 1 and manifest["split_membership"] == st.counts["train"] + st.counts["val"]
    bundle = read_bundle(spark, root)
    assert bundle.prep == st.prep and bundle.config.thr == st.best_fusion["thr"] and bundle.best_nu == st.best_nu
    assert bundle.boundary == st.boundary.boundaries[st.boundary.nus.index(st.best_nu)]
    assert bundle.forest.nodes.equals(forest.nodes.astype(bundle.forest.nodes.dtypes)) and bundle.forest_threshold == 0.5
    d = st.deploy_columns()
    want = {r[0]: (r[1], r[2]) for r in st.scored.where("split = 'val' OR y = 1").select("row_id", d["z"], d["pred"]).collect()}
    flows = st.flows.select("row_id", "src_file", *st.features)
    batch = deploy(flows, bundle.scorer(), bundle.config).collect()
    got = {r[0]: (r[1], r[2]) for r in batch}           # the evaluated rows have ids of their own
    assert all(got[k][0] == pytest.approx(v[0], abs=1e-9) and got[k][1] == v[1] for k, v in want.items())

    half = F.crc32("row_id") % 2 == 0
    flows.where(half).select(F.col("row_id").alias(" id"), *st.features).write.option("header", True).csv(str(tmp_path / "in/a"))
    (tmp_path / "in/empty.csv").write_text("")
    kw = dict(key_col="id", keep=("row_id",), files_per_batch=3)
    args = (spark, str(tmp_path / "in"), bundle, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    score_csv_stream(*args, **kw).awaitTermination()
    flows.where(~half).select(*reversed(st.features), F.lit("BENIGN").alias("Label"), F.col("row_id").alias("id")).write.option(
        "header", True).csv(str(tmp_path / "in/b"))
    for _ in range(2):          # a restart takes up the new files; one more finds nothing
        score_csv_stream(*args, **kw).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).select("row_id", "z", "pred").collect()
    assert sorted(map(tuple, rows)) == [(i, pytest.approx(z, abs=1e-9), p) for i, z, p in sorted(map(tuple, batch))]


def test_documents_are_nested(spark, fitted, tmp_path):
    from flowsentry.sources.artifacts import document, write_bundle, write_json
    root = str(tmp_path / "bundle")
    write_bundle(spark, root, fitted)
    read = lambda name: spark.read.json(f"{root}/{name}")
    fus = read("fusion_config").first()
    assert set(fus.asDict()) == {"w_svm", "w_ae", "thr", "thr_quantile", "svm_ref", "ae_ref"} and fus["svm_ref"]["mad"] > 0
    run = read("run_config").first()
    assert run["config"]["seed"] == 42 and run["config"]["autoencoder"]["num_epochs"] == 1 and run["preprocess"]["features"] == fitted.prep.features
    cls = read("classical_results").first()
    assert cls["best_nu"] == fitted.best_nu and len(cls["one_class_svm_search"]) == 3 and cls["isolation_forest"] is None
    assert {f["family"] for f in cls["one_class_svm_search"][0]["per_family"]} == set(fitted.families)
    assert all(0 <= f["roc_auc"] <= 1 for f in cls["one_class_svm_per_family"])
    dl = read("dl_results").first()
    assert len(dl["random_search_trials"]) == 2 and dl["chosen_arch"]["h1"] > 0 and dl["benign_val_mse_mean"] > 0
    assert dl["best_threshold_mse"] == fitted.best_thr and len(dl["per_family_best"]) == len(fitted.families)
    hyb = read("hybrid_results").first()
    assert hyb["fusion_calibration"]["deploy_thr"] == hyb["fusion_calibration"]["thr"] and len(hyb["ablation_preview"]) == 3
    ml = next(r for r in hyb["ablation_preview"] if r["model"] == "ML_only_OC_SVM")
    assert ml["mean_fold_roc_auc"] is None
    text = spark.read.text(f"{root}/hybrid_results").first()[0]
    assert '"mean_fold_roc_auc":null' in text and "NaN" not in text
    doc = document(spark, {"a": float("nan"), "b": [], "c": [{"x": 1}, {"x": None, "y": [1.5]}], "d": None, "e": {"f": True}})
    assert doc.first().asDict(True) == {"a": None, "b": [], "c": [{"x": 1, "y": None}, {"x": None, "y": [1.5]}], "d": None, "e": {"f": True}}
    write_json(doc, str(tmp_path / "doc"))
    with pytest.raises(ValueError):
        document(spark, {"a": [1, "x"]})


def test_custom_scorers_are_not_in_a_bundle(fitted):
    from flowsentry.sources.artifacts import Bundle
    with pytest.raises(ValueError):
        Bundle(None, None, "custom", 0.1, 0.1, {0.1: 0.0}).scorer()


def test_csv_scan_with_stated_features(spark, tmp_path):
    from flowsentry.sources.flow_csv import read_flow_files
    (tmp_path / "a.csv").write_text("x, y\n1,2\nzz,inf\n")
    flows, features = read_flow_files(spark, [str(tmp_path / "a.csv")], features=["y", "x", "w"], need_label=False)
    assert features == ["y", "x", "w"] and "y" in flows.columns and "attack_family" not in flows.columns
    assert sorted((r["x"], r["w"]) for r in flows.collect() if r["x"]) == [(1.0, None)]
    assert read_flow_files(spark, [], features=["x"]) is None
