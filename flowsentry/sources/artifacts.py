"""Artifact sinks (A5-A13): JSON documents, report CSVs, model bundle tables
and the deploy fusion config, and the reader of a bundle.

Report documents are family- or candidate-sized, so they are written as a
single JSON/CSV file each (``coalesce(1)`` on a tiny frame); JSON documents
are struct-typed frames, so ``spark.read.json`` gives their nested fields.
Models are written as parquet tables of arrays (no pickles); the bundle folder
carries a manifest table (path, kind, rows).  ``read_bundle`` turns the tables
back into fitted objects, whose ``scorer`` takes batch and streaming frames.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, is_dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import max_abs, mean_square
from ..operators.detectors.autoencoder import BATCH, EPOCHS, AutoEncoder
from ..operators.detectors.iforest import NODE_SCHEMA, Forest
from ..operators.detectors.oneclass import TOL, OneClassModel, RFFMap
from ..operators.preprocess import Preprocessor


def write_json(df: DataFrame, path: str) -> None:
    """A5: report-sized frame -> one JSON-lines file (nulls are written)."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Report-sized frame -> one CSV with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def document(spark: SparkSession, payload: dict) -> DataFrame:
    """A nested document as a one-row frame of structs and arrays
    (strict JSON: NaN -> null; a value that is null everywhere is a string)."""
    payload = _strict(payload)
    return spark.createDataFrame([payload], _known(_typed(payload)))


def _strict(v):
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, float) and v != v:
        return None
    if isinstance(v, dict):
        return {str(k): _strict(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_strict(x) for x in v]
    return v


def _typed(v) -> T.DataType:
    """The type of a value; of the elements of a list, a type for all."""
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, _typed(x)) for k, x in v.items()])
    if isinstance(v, list):
        return T.ArrayType(reduce(_merged, map(_typed, v), T.NullType()))
    if v is None:
        return T.NullType()
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(v), T.StringType())


def _known(t: T.DataType) -> T.DataType:
    """String where no type is known."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _known(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_known(t.elementType))
    return T.StringType() if isinstance(t, T.NullType) else t


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        own, other = {f.name: f.dataType for f in a}, {f.name: f.dataType for f in b}
        return T.StructType([T.StructField(n, _merged(own.get(n, T.NullType()), other.get(n, T.NullType()))) for n in {**own, **other}])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merged(a.elementType, b.elementType))
    raise ValueError(f"a list holds {a.simpleString()} and {b.simpleString()}")


FUSION_SCHEMA = ("w_svm double, w_ae double, thr double, thr_quantile double, "
                 "svm_ref struct<median: double, mad: double>, ae_ref struct<median: double, mad: double>")


@dataclass(frozen=True)
class FusionConfig:
    """Deploy configuration (fixed layout of the reference's fusion config)."""
    w_svm: float
    w_ae: float
    thr: float
    thr_quantile: float | None
    svm_median: float
    svm_mad: float
    ae_median: float
    ae_mad: float

    def to_json(self) -> str:
        return json.dumps({
            "w_svm": self.w_svm, "w_ae": self.w_ae, "thr": self.thr,
            "thr_quantile": self.thr_quantile,
            "svm_ref": {"median": self.svm_median, "mad": self.svm_mad},
            "ae_ref": {"median": self.ae_median, "mad": self.ae_mad},
        }, indent=2)

    @staticmethod
    def from_json(text: str) -> "FusionConfig":
        d = json.loads(text)
        return FusionConfig(float(d["w_svm"]), float(d["w_ae"]), float(d["thr"]),
                            None if d.get("thr_quantile") is None else float(d["thr_quantile"]),
                            float(d["svm_ref"]["median"]), float(d["svm_ref"]["mad"]),
                            float(d["ae_ref"]["median"]), float(d["ae_ref"]["mad"]))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row in the published nested layout."""
        return spark.createDataFrame([json.loads(self.to_json())], FUSION_SCHEMA)

    def fused(self, svm_score, ae_score):
        """(fused z, prediction) columns from the two raw scores."""
        z = (F.lit(self.w_svm) * ((svm_score - F.lit(self.svm_median)) / F.lit(self.svm_mad))
             + F.lit(self.w_ae) * ((ae_score - F.lit(self.ae_median)) / F.lit(self.ae_mad)))
        return z, (z > F.lit(self.thr)).cast("byte")


def fusion_config_from_study(st) -> FusionConfig:
    b = st.best_fusion
    (sm, sd), (am, ad) = st.robust_refs["svm"], st.robust_refs["ae"]
    return FusionConfig(b["w_svm"], b["w_ae"], b["thr"], b["thr_quantile"], sm, sd, am, ad)


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a family-sized frame."""
    return [r.asDict(recursive=True) for r in df.collect()]


def write_bundle(spark: SparkSession, root: str, st, budget=None, forest: tuple[Forest, float] | None = None,
                 iforest_rows: DataFrame | None = None) -> DataFrame:
    """One deploy folder with every table the scorer needs, the
    result documents and a manifest, which is returned.

    ``budget``: the data budget of the run, for its configuration.  ``forest``:
    (isolation forest, its threshold); ``iforest_rows``: its per-family
    metrics."""
    root = root.rstrip("/")
    entries = []
    learned = st.detectors == "learned"
    _ = st.scored.columns       # fits the detectors

    def put(df: DataFrame, name: str, kind: str, fmt: str = "parquet", small: bool = True):
        """Report/model-sized tables go to one file; data-sized ones keep
        their partitioning (never funnelled through one task)."""
        path = f"{root}/{name}"
        if fmt == "json":
            write_json(df, path)
        elif fmt == "csv":
            write_csv(df, path)
        elif small:
            df.coalesce(1).write.mode("overwrite").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)
        written = spark.read.option("header", fmt == "csv").schema(df.schema).format(fmt).load(path)
        entries.append((name, kind, written.count()))

    # What the scorer needs
    prep, cfg, best = st.prep, fusion_config_from_study(st), st.best_fusion
    put(prep.to_frame(spark), "preprocess", "preprocessor")
    put(spark.createDataFrame([(prep.to_json(),)], "doc string"), "preprocess_json", "preprocessor", "json")
    put(cfg.to_frame(spark), "fusion_config", "fusion_config", "json")
    nus = [(nu, float(b)) for nu, b in zip(st.boundary.nus, st.boundary.boundaries)]
    put(spark.createDataFrame(nus, "nu double, boundary double"), "oc_boundaries", "ml_model")
    put(spark.createDataFrame([(st.detectors, float(st.best_nu), float(st.best_thr))],
                              "detectors string, best_nu double, ae_threshold double"), "operating_point", "config")
    if learned:
        oc, ae = st.oc_model, st.ae_model
        put(spark.createDataFrame([(oc.rff.W.ravel().tolist(), list(oc.rff.W.shape), oc.rff.b.tolist(),
                                    oc.w.ravel().tolist(), list(oc.w.shape), list(oc.cols),
                                    list(oc.nus) if oc.nus else None)],
                                  "frequencies array<double>, frequencies_shape array<int>, phases array<double>, "
                                  "weights array<double>, weights_shape array<int>, cols array<string>, nus array<double>"), "oc_model", "ml_model")
        put(spark.createDataFrame([(i, p.ravel().tolist(), list(p.shape)) for i, p in enumerate(ae.params)],
                                  "layer int, values array<double>, shape array<int>"), "ae_params", "dl_model")
        put(spark.createDataFrame([(list(ae.dims), list(ae.cols))], "dims array<int>, cols array<string>"),
            "ae_arch", "dl_model", "json")
    if forest:
        model, threshold = forest
        put(spark.createDataFrame(model.nodes, NODE_SCHEMA), "iforest_nodes", "ml_model")
        put(spark.createDataFrame([(model.psi, list(model.cols), float(threshold))],
                                  "psi int, cols array<string>, threshold double"), "iforest_model", "ml_model")

    # Run configuration, and split membership (row_id, split), never positions
    config = {"seed": st.seed, "corr_threshold": prep.corr_threshold, "train_share": prep.train_share, "nu_values": list(st.nus),
              "calib_fraction": st.calib_fraction, "detectors": st.detectors, "selection_families": st.selection_families,
              "mse_thresholds": list(st.thr_grid),
              "autoencoder": {"batch_size": BATCH, "num_epochs": st.learned_options.get("ae_epochs", EPOCHS),
                              "random_search_trials": len(st.ae_trials)} if learned else None,
              "one_class": {"components": len(st.oc_model.rff.b), "fit_rows": st.learned_options.get("oc_fit_rows"),
                            "tolerance": st.learned_options.get("oc_tol", TOL), "rounds": st.oc_model.rounds} if learned else None,
              "budget": asdict(budget) if is_dataclass(budget) else budget}
    put(document(spark, {"config": config,
                         "preprocess": {"features": prep.features, "dropped_corr_cols": prep.dropped, "corr_threshold": prep.corr_threshold,
                                        "feature_impute_medians": prep.medians, "means": prep.means, "scales": prep.scales,
                                        "n_train": prep.n_train, "n_val": prep.n_val}}), "run_config", "config", "json")
    put(st.split_frame.where(F.col("split").isNotNull()).select("row_id", "split"), "split_membership", "split",
        small=False)

    # Best nu, its families, the search log, the forest's part
    by_nu: dict[str, list[dict]] = {}
    for r in _rows(st.nu_metrics):
        by_nu.setdefault(r.pop("candidate"), []).append(r)
    search = [{"nu": r["nu"], "macro_f1": r["macro_f1"], "benign_val_accuracy": r["benign_val_accuracy"],
               "per_family": by_nu.get(r["candidate"], [])} for r in st.nu_summary]
    chosen = next(r for r in search if r["nu"] == st.best_nu)
    iforest = _rows(iforest_rows) if iforest_rows is not None else []
    put(document(spark, {"best_nu": st.best_nu, "best_macro_f1": chosen["macro_f1"],
                         "one_class_svm_per_family": _rows(st.nu_metrics_auc.where(F.col("candidate") == f"nu={st.best_nu}")),
                         "one_class_svm_search": search,
                         "isolation_forest": {"macro_f1": float(np.mean([r["f1_macro"] for r in iforest])),
                                              "per_family": iforest} if iforest else None}), "classical_results", "report", "json")
    # Trials, chosen architecture, mean validation error, threshold log, families at the best threshold
    trials = st.ae_trials if learned else []
    arch = min(trials, key=lambda r: r["best_val_mse_mean"]) if trials else None
    mean_val = st.scored.where(F.col("split") == "val").agg(F.avg("ae")).first()[0]
    grid = [{"threshold": r["threshold"], "macro_f1": r["macro_f1"]} for r in st.thr_summary]
    put(document(spark, {"random_search_trials": trials, "chosen_arch": arch, "benign_val_mse_mean": mean_val,
                         "threshold_grid_summary": grid, "best_threshold_mse": st.best_thr,
                         "best_macro_f1": max((r["macro_f1"] for r in grid), default=None),
                         "per_family_best": _rows(st.thr_metrics.where(F.col("candidate") == f"thr={st.best_thr}"))}),
        "dl_results", "report", "json")
    # Family roles, the chosen fusion, the ablation
    summary = st.ablation_summary()
    put(summary, "ablation_summary", "report")
    put(document(spark, {"calibration_attack_families": st.family_roles[0], "evaluation_attack_families": st.family_roles[1],
                         "fusion_calibration": {**best, "deploy_thr": cfg.thr, "ae_threshold": st.best_thr, "oc_nu": st.best_nu},
                         "ablation_preview": _rows(summary)}), "hybrid_results", "report", "json")
    # Report tables as CSV (Table 2 and both Table 3 variants)
    from ..operators.reports import ae_table, class_by_nu_table
    for name, tbl in (("table2_accuracy_by_nu", class_by_nu_table(st)),
                      ("table3_accuracy", ae_table(st, "accuracy")),
                      ("table3_f1macro", ae_table(st, "f1_macro"))):
        put(tbl, name, "report_csv", "csv")
    manifest = spark.createDataFrame(entries, "path string, kind string, rows long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
    return manifest


@dataclass(frozen=True)
class Bundle:
    """A fitted run, as read from its folder."""
    prep: Preprocessor
    config: FusionConfig
    detectors: str
    best_nu: float
    ae_threshold: float
    boundaries: dict[float, float]
    oc: OneClassModel | None = None
    ae: AutoEncoder | None = None
    forest: Forest | None = None
    forest_threshold: float | None = None

    @property
    def boundary(self) -> float:
        return self.boundaries[self.best_nu]

    def scorer(self) -> Callable[[DataFrame], DataFrame]:
        """Adds svm_score (above 0: outside the best nu's boundary) and ae_score
        to any flow frame, batch or streaming; absent features are missing
        values."""
        if self.detectors == "simple":
            return expression_scorer(self.prep, self.boundary)
        if self.detectors != "learned":
            raise ValueError(f"the scorers of detectors={self.detectors!r} are the caller's own and not in a bundle")
        oc, raw = self.oc.for_nu(self.best_nu), "_ml_raw"

        def run(df: DataFrame) -> DataFrame:
            z = self.prep.transform(df, prefix="z_")
            scored = self.ae.score(oc.score(z, raw), "ae_score")
            return scored.withColumn("svm_score", F.col(raw) - F.lit(self.boundary)).drop(raw)
        return run


def expression_scorer(prep: Preprocessor, boundary: float) -> Callable[[DataFrame], DataFrame]:
    """ML = max |z| minus the nu boundary, DL = mean z^2 (expression detectors)."""
    def run(df: DataFrame) -> DataFrame:
        z = prep.transform(df, prefix="z_")
        zc = [f"z_{f}" for f in prep.features]
        return z.withColumn("svm_score", max_abs(zc) - F.lit(float(boundary))).withColumn("ae_score", mean_square(zc))
    return run


def read_bundle_config(spark: SparkSession, root: str) -> FusionConfig:
    row = spark.read.schema(FUSION_SCHEMA).json(f"{root.rstrip('/')}/fusion_config").first()
    return FusionConfig.from_json(json.dumps(row.asDict(recursive=True)))


def read_bundle(spark: SparkSession, root: str) -> Bundle:
    """The fitted objects of ``write_bundle``; which models there are is
    told by the manifest."""
    root = root.rstrip("/")
    there = {r["path"] for r in spark.read.parquet(f"{root}/manifest").select("path").collect()}
    table = lambda name: spark.read.parquet(f"{root}/{name}")
    point = table("operating_point").first()
    prep = Preprocessor.from_json(spark.read.schema("doc string").json(f"{root}/preprocess_json").first()["doc"])
    bundle = Bundle(prep, read_bundle_config(spark, root), point["detectors"], point["best_nu"], point["ae_threshold"],
                    {r["nu"]: r["boundary"] for r in table("oc_boundaries").collect()})
    if "oc_model" in there:
        r = table("oc_model").first()
        rff = RFFMap(np.array(r["frequencies"]).reshape(r["frequencies_shape"]), np.array(r["phases"]))
        bundle = replace(bundle, oc=OneClassModel(rff, np.array(r["weights"]).reshape(r["weights_shape"]), tuple(r["cols"]),
                                                  tuple(r["nus"]) if r["nus"] else None))
    if "ae_params" in there:
        arch = spark.read.schema("dims array<int>, cols array<string>").json(f"{root}/ae_arch").first()
        layers = table("ae_params").orderBy("layer").collect()
        bundle = replace(bundle, ae=AutoEncoder(list(arch["dims"]), [np.array(r["values"]).reshape(r["shape"]) for r in layers],
                                                tuple(arch["cols"])))
    if "iforest_model" in there:
        r = table("iforest_model").first()
        bundle = replace(bundle, forest=Forest(table("iforest_nodes").toPandas(), r["psi"], tuple(r["cols"])),
                         forest_threshold=r["threshold"])
    return bundle
