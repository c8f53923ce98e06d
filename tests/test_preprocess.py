"""Pruning chain, scaler semantics, medians, robust z."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.functions.expr import robust_z
from flowsentry.operators import quantiles as Q
from flowsentry.operators.preprocess import fit_preprocess, prune_correlated


def test_prune_chain_not_transitive():
    r = np.array([[1, .95, .8], [.95, 1, .95], [.8, .95, 1]])
    assert prune_correlated(["a", "b", "c"], r) == ["b", "c"]


def test_prune_strict_and_constant():
    r = np.array([[1, .9, np.nan], [.9, 1, np.nan], [np.nan, np.nan, 1]])
    assert prune_correlated(["a", "b", "k"], r) == []


def _flows(spark, rows):
    return spark.createDataFrame(
        [(f"r{i}", 0, "Benign", "BENIGN", "Benign (Validation)", *v) for i, v in enumerate(rows)],
        "row_id string, y int, attack_family string, cic_label string, report_name string, a double, k double")


def test_constant_column_scales_by_one(spark):
    df = _flows(spark, [(float(i), 3.0) for i in range(40)])
    prep, _ = fit_preprocess(df, ["a", "k"], train_share=1.0)
    assert "k" in prep.features
    k = prep.features.index("k")
    assert prep.scales[k] == 1.0 and prep.means[k] == pytest.approx(3.0)
    z = prep.transform(spark.createDataFrame([(0.0, 7.0)], "a double, k double")).first()
    assert z["k"] == pytest.approx(4.0)


def test_population_std(spark):
    df = _flows(spark, [(float(i % 10), 1.0) for i in range(100)])
    prep, _ = fit_preprocess(df, ["a", "k"], train_share=1.0)
    assert prep.stds[prep.features.index("a")] == pytest.approx(2.872281, abs=1e-6)


def test_robust_z(spark):
    ref = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double")
    med = Q.quantiles(ref, ["x"], [0.5])["x"][0]
    mad = Q.quantiles(ref.select(F.abs(F.col("x") - med).alias("d")), ["d"], [0.5])["d"][0] + 1e-9
    assert (med, round(mad, 6)) == (3.0, 1.0)
    z = spark.range(1).select(robust_z(F.lit(5.0), med, mad).alias("z")).first()["z"]
    assert z == pytest.approx(2.0, abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantile_refinement_equals_percentile(spark, n):
    rng = np.random.default_rng(n)
    vals = np.concatenate([rng.normal(size=n), rng.integers(0, 5, n).astype(float)])
    df = spark.createDataFrame([(float(v), float(v) * 2) for v in vals], "x double, y double")
    qs = [0.0, 0.1, 0.5, 0.92, 0.95, 1.0]
    exact = Q.quantiles(df, ["x", "y"], qs)
    refined = Q.quantiles(df, ["x", "y"], qs, buckets=16)
    for c in ("x", "y"):
        ref = np.quantile(vals * (1 if c == "x" else 2), qs)
        assert np.allclose(exact[c], ref) and np.allclose(refined[c], ref)


def test_quantile_refinement_few_buckets(spark):
    rng = np.random.default_rng(9)
    vals = np.exp(rng.normal(scale=12, size=500))  # values spread over many magnitudes
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = Q.quantiles(df, ["x"], [0.1, 0.5, 0.9], buckets=4)["x"]
    assert np.allclose(got, np.quantile(vals, [0.1, 0.5, 0.9]), rtol=1e-9)


def test_quantile_refinement_full_double_range(spark):
    vals = [-1.7e308, -1.0, 0.0, 2.0, 1.7e308]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert Q.quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0], buckets=4)["x"] == vals
