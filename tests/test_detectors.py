"""Learned detectors on a seeded synthetic flow table with separable families."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import metrics as M
from flowsentry.operators.detectors import autoencoder as AE
from flowsentry.operators.detectors import iforest as IF
from flowsentry.operators.detectors import oneclass as OC
from flowsentry.operators.detectors import pca as PC

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def synth(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        x = rng.normal(size=4)
        rows.append((f"b{i}", 0, "Benign (Validation)", "train" if i < 2200 else "val", *map(float, x)))
    for i in range(400):
        x = rng.normal(size=4) * 0.6 + np.array([3.0, -3.0, 0.0, 2.0])
        rows.append((f"s{i}", 1, "Shifted", None, *map(float, x)))
    for i in range(400):
        x = rng.normal(size=4) * 4.0
        rows.append((f"w{i}", 1, "Wide", None, *map(float, x)))
    schema = "row_id string, y int, family string, split string, " + ", ".join(f"{c} double" for c in COLS)
    return spark.createDataFrame(rows, schema).cache()


def aucs(df, col):
    return {r["family"]: r["roc_auc"] for r in M.fold_auc(df, {"s": F.col(col)}, "family").collect()}


def test_oneclass_nu_property_and_detection(synth):
    train = synth.where("split = 'train'")
    model = OC.fit(train, COLS, n_components=256, seed=1)
    scored = model.score(synth, "oc")
    from flowsentry.operators import quantiles as Q
    for nu in (0.2, 0.1):
        bnd = Q.quantiles(scored.where("split = 'train'"), ["oc"], [1 - nu])["oc"][0]
        share = scored.where("split = 'train'").select(F.avg((F.col("oc") > bnd).cast("double"))).first()[0]
        assert share == pytest.approx(nu, abs=0.01)
    a = aucs(scored, "oc")
    assert a["Shifted"] > 0.9 and a["Wide"] > 0.8


def test_iforest_detects(synth):
    forest = IF.fit(synth.where("split = 'train'"), COLS, n_trees=50, psi=128, seed=3)
    assert forest.nodes.groupby("tree").size().max() <= 2 * 128
    a = aucs(forest.score(synth, "if"), "if")
    assert a["Shifted"] > 0.9 and a["Wide"] > 0.8


def test_forest_scores_walk_full_trees_a_level_at_a_time(synth):
    """Each tree is a full one in arrays, and scores equal a walk node by node,
    for leaves on every level, missing values and values on a threshold."""
    grown = IF.fit(synth.where("split = 'train'"), COLS, n_trees=6, psi=32, seed=3).nodes
    alone = pd.DataFrame([(9, 0, -1, 0.0, -1, -1, 5)], columns=grown.columns)
    forest = IF.Forest(pd.concat([grown, alone]), 32, tuple(COLS))
    for feat, thr, lengths in forest._arrays():
        assert len(feat) == len(thr) == len(lengths) - 1 and len(lengths).bit_count() == 1
    thr = float(grown[grown["feature"] == 0]["threshold"].iloc[0])
    rows = synth.limit(300).withColumn(COLS[0], F.when(F.rand(1) < 0.1, F.lit(thr)).when(F.rand(2) < 0.9, F.col(COLS[0]))).toPandas()
    got = forest.score(synth.sparkSession.createDataFrame(rows), "if").toPandas()
    for _, r in got.iterrows():
        total = 0.0
        for _, tree in forest.nodes.groupby("tree"):
            node = tree.iloc[0]
            depth = 0
            while node["feature"] >= 0:
                depth += 1
                node = tree.iloc[int(node["left"] if r[COLS[int(node["feature"])]] < node["threshold"] else node["right"])]
            total += depth + IF.c_factor(float(node["size"]))
        assert r["if"] == pytest.approx(2.0 ** (-total / 7 / IF.c_factor(32)), rel=1e-12)


def test_forest_draws_rows_without_replacement(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("row_id"))
    for n_trees, per_row in ((12, 3.5), (12, 40.0), (7, 0.25), (1, 1.5)):
        got = IF.tree_slots(rows, n_trees, per_row, 42).groupBy("row_id", "tree").count()
        assert got.where("count > 1").count() == 0
        total = got.count()
        assert abs(total - 400 * min(per_row, n_trees)) <= 4 * (400 * max(1.0, per_row)) ** 0.5      # four deviations
        assert got.select("tree").distinct().count() == n_trees
    first = [IF.tree_slots(rows.repartition(n), 12, 3.5, 42).select("row_id", "tree", "h") for n in (1, 5)]
    assert sorted(map(tuple, first[0].collect())) == sorted(map(tuple, first[1].collect()))


def test_c_factor():
    assert IF.c_factor(2) == 1.0 and IF.c_factor(1) == 0.0
    assert IF.c_factor(256) == pytest.approx(10.2447, abs=1e-3)


def test_autoencoder_gradients():
    rng = np.random.default_rng(0)
    params = AE.init_params(AE.layer_dims(3, 5, 4, 5), 0)
    x = rng.normal(size=(7, 3))
    g = AE._grads(params, x)
    eps = 1e-6
    for k in (0, 3, 10):
        p = params[k]
        idx = tuple(0 for _ in p.shape)
        old = p[idx]
        p[idx] = old + eps
        up = np.mean((AE.forward(params, x)[0] - x) ** 2)
        p[idx] = old - eps
        dn = np.mean((AE.forward(params, x)[0] - x) ** 2)
        p[idx] = old
        assert g[k][idx] == pytest.approx((up - dn) / (2 * eps), rel=1e-4, abs=1e-8)


def test_autoencoder_trains_and_detects(synth):
    train = synth.where("split = 'train'")
    val = synth.where("split = 'val'")
    model, best, hist = AE.train(train, val, COLS, (16, 8, 16), 1e-2, 1e-4, epochs=6, batch=128, seed=5,
                                 slots=2)
    assert len(hist) == 6 and best == min(hist) and hist[-1] < hist[0]
    a = aucs(model.score(synth, "ae"), "ae")
    assert a["Shifted"] > 0.9 and a["Wide"] > 0.8


def test_pca_recon(synth):
    axes = PC.fit_axes(synth.where("split = 'train'"), COLS, k=2)
    assert axes.shape == (4, 2)
    scored = PC.with_recon_error(synth, COLS, axes, "pca")
    x = np.array(scored.select(*COLS).collect())
    err = np.array([r[0] for r in scored.select("pca").collect()])
    resid = x - (x @ axes) @ axes.T
    assert np.allclose(err, np.mean(resid ** 2, axis=1), atol=1e-9)


def plain_one_class(z, nu, tol=1e-4):
    """Objective of the one-class problem over the rows of z, by conditional
    gradient steps until its gap is 1e-4 of it; nu times rows is whole."""
    k = round(nu * len(z))
    w = z.mean(axis=0)
    while True:
        v = z[np.argpartition(z @ w, k)[:k]].mean(axis=0)
        d = w - v
        if w @ d <= tol * 0.5 * (w @ w):
            return 0.5 * (w @ w)
        w = w - min(1.0, (w @ d) / (d @ d)) * d


def test_shortest_vector_of_a_hull():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 12):
        atoms = rng.normal(size=(n, 6)) + 1.0
        weight = OC._shortest(atoms)
        w = weight @ atoms
        assert weight.min() >= 0 and weight.sum() == pytest.approx(1.0)
        assert (atoms @ w).min() >= w @ w - 1e-9          # no atom leads further down
    assert OC._shortest(np.ones((3, 2))).sum() == pytest.approx(1.0)


def test_lowest_mean_by_bins_is_feasible_and_bounded():
    rng = np.random.default_rng(5)
    z, w = rng.normal(size=(500, 3)), rng.normal(size=3)
    s, edges = z @ w, OC._edges(-0.7, 6.0)
    assert len(edges) == OC.BINS - 1 and (np.diff(edges) > 0).all()
    place = np.searchsorted(edges, s, side="right")
    sums = np.array([[(place == b).sum(), *z[place == b].sum(axis=0)] for b in range(OC.BINS)])
    v, bound, _, _ = OC._lowest_mean(sums, edges, w, 100)
    lowest = np.sort(s)[:100].mean()
    assert bound <= lowest + 1e-12 and v @ w >= lowest - 1e-12 and v @ w - bound < 0.05


def test_training_is_independent_of_partitions(spark, synth):
    train, val = synth.where("split = 'train'"), synth.where("split = 'val'")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = train.repartition(int(n))
            model, best, hist = AE.train(rows, val, COLS, (8, 4, 8), 1e-2, 1e-4, epochs=2, batch=64, seed=5, slots=20)
            oc = OC.fit(rows, COLS, n_components=32, seed=2, nus=(0.1,), gamma=0.2, slots=20)
            got.append((hist, [p.tolist() for p in model.params], oc.w.tolist()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got[0] == got[1] == got[2]


def test_autoencoder_without_rows(synth):
    none = synth.where("false")
    model, best, hist = AE.train(none, none, COLS, (8, 4, 8), 1e-2, 1e-4, epochs=2)
    assert hist == [] and best == float("inf") and model.score(none, "ae").count() == 0
    assert OC.fit(none, COLS, n_components=16, nus=(0.1,)).w.shape == (1, 16)


def test_oneclass_solved_per_nu(synth):
    from flowsentry.operators import quantiles as Q
    train = synth.where("split = 'train'")
    nus = (0.2, 0.1)
    model = OC.fit(train, COLS, n_components=128, seed=2, nus=nus)
    assert model.w.shape == (2, 128) and model.rounds < OC.ROUNDS
    z = OC._phi(model.rff)(np.array(train.select(*COLS).collect()))
    for k, nu in enumerate(nus):
        best = plain_one_class(z, nu)
        assert best <= model.objective[k] + 1e-9 and model.objective[k] <= 1.01 * best
        assert model.objective[k] - best <= model.gap[k] <= OC.TOL * model.objective[k]
    scored = model.score(synth, "oc")
    for k, nu in enumerate(nus):
        col = f"oc_{k}"
        bnd = Q.quantiles(scored.where("split = 'train'"), [col], [1 - nu])[col][0]
        share = scored.where("split = 'train'").select(F.avg((F.col(col) > bnd).cast("double"))).first()[0]
        assert share == pytest.approx(nu, abs=0.01)
        a = aucs(scored, col)
        assert a["Shifted"] > 0.9 and a["Wide"] > 0.8


def test_learned_study_with_solved_oneclass(spark):
    from flowsentry.plans.study import Study
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    from tests.conftest import SF_SMALL
    st = Study(lineitem_flows(spark, SF_SMALL), LINEITEM_FEATURES, detectors="learned",
               learned_options={"rff_components": 64, "oc_tol": 0.05, "ae_epochs": 1, "ae_trials": 1})
    assert "ml_raw_0" in st.scored.columns and len(st.nu_summary) == 3
    assert st.ablation_summary().count() == 3


def test_training_is_single_precision_with_double_sums():
    rng = np.random.default_rng(3)
    rff, x = OC.make_map(4, 0.25, 64, seed=2), rng.normal(size=(300, 4))
    z = OC._phi(rff)(x)
    assert z.dtype == np.float32 and np.abs(z - rff.transform(x)).max() < 1e-6
    dims = AE.layer_dims(4, 8, 4, 8)
    start = AE._flat(AE.init_params(dims, 0))
    worker = AE._Worker(([start, 0 * start, 0 * start], 0), [p.shape for p in AE.init_params(dims, 0)], 1e-3, 1e-4, 64, (1, 0, 0))
    worker.add(x)
    n, steps, _, total = worker.end()
    assert (n, steps) == (300, 5) and total.dtype == np.float64
    assert all(p.dtype == np.float32 for p in worker.p + worker.m + worker.v)


def test_each_slot_is_a_partition_of_its_own(spark, synth):
    """Slots hashed to partitions left some empty and put several into one."""
    from flowsentry.operators import tree
    train = synth.where("split = 'train'")
    dealt = tree.slotted(train, COLS, 20).withColumn("p", F.spark_partition_id())
    held = dealt.select("p", "slot").distinct().collect()
    assert sorted((r["p"], r["slot"]) for r in held) == [(s, s) for s in range(20)]
    rows = train.select(F.pmod(F.xxhash64("row_id"), F.lit(20)).cast("int").alias("slot"), F.xxhash64("row_id", F.lit(1)).alias("o"), *COLS).toPandas()
    got = dealt.groupBy("slot").agg(F.collect_list("x").alias("x")).toPandas()
    for _, r in got.iterrows():
        want = rows[rows["slot"] == r["slot"]].sort_values("o")[COLS].to_numpy(dtype=np.float32)
        assert np.array_equal(np.frombuffer(b"".join(r["x"]), np.float32).reshape(-1, len(COLS)), want)


def test_features_by_polynomial_equal_cosines():
    rng = np.random.default_rng(6)
    rff, x = OC.make_map(4, 0.25, 96, seed=2), rng.normal(size=(2500, 4)) * 5
    x[0] = 0.0
    z = np.vstack([b.copy() for _, b in OC._Phi(rff, np.float64).blocks(x)])
    assert z.dtype == np.float64 and np.abs(z - rff.transform(x)).max() < 5e-15
    assert np.abs(OC._phi(rff)(x) - rff.transform(x)).max() < 5e-6


def test_quantile_bin_beyond_the_summed_ones_is_counted_again(synth, monkeypatch):
    """Only rows in bins near the quantile are summed; where it lies beyond,
    the round gives what all bins' sums give."""
    train = synth.where("split = 'train'")
    upto = []
    bin_sums = OC._bin_sums
    monkeypatch.setattr(OC, "_bin_sums", lambda *a: upto.append(a[-1].tolist()) or bin_sums(*a))
    got = []
    for near in (OC.BINS - 1, OC.NEAR, 2):
        monkeypatch.setattr(OC, "NEAR", near)
        got.append(OC.fit(train, COLS, n_components=64, seed=2, nus=(0.2, 0.1), gamma=0.2, slots=3))
        if near == OC.BINS - 1:
            upto.clear()
    assert any(n != [2] * len(n) for n in upto) and [2, 2] in upto
    for m in got[1:]:
        assert m.rounds == got[0].rounds
        assert np.allclose(m.w, got[0].w, rtol=0, atol=1e-6) and np.allclose(m.gap, got[0].gap, rtol=0, atol=1e-7)


def test_learned_scores_take_one_pass_over_python(spark):
    """Both detectors score in one pass that only features take, and the fits
    read a table, not a cache of the scaled rows."""
    from flowsentry.operators.detectors import learned
    from flowsentry.plans.study import Study
    from flowsentry.sources.tables import LINEITEM_FEATURES, lineitem_flows
    from tests.conftest import SF_SMALL
    st = Study(lineitem_flows(spark, SF_SMALL), LINEITEM_FEATURES, detectors="learned",
               learned_options={"rff_components": 32, "oc_tol": 0.1, "ae_epochs": 1, "ae_trials": 1})
    out = learned.learned_scores(st)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapIn" not in plan and "InMemoryTableScan" not in plan
    rest = ["row_id", "y", "family", "split", *st.zcols]
    assert out.select(*rest).exceptAll(st.scaled.select(*rest)).count() == 0 and out.count() == st.scaled.count()
    names = [*st.oc_model.out_cols("ml_raw"), "ae"]
    apart = st.ae_model.score(st.oc_model.score(st.scaled, "ml_raw"), "ae").select(*rest, *names)
    order = ["row_id", *st.zcols]
    one, two = (df.toPandas().sort_values(order) for df in (out.select(*rest, *names), apart))
    assert np.allclose(one[names], two[names], rtol=0, atol=1e-12)
    x, scores = one[st.zcols].to_numpy(), one[names].to_numpy()
    assert np.allclose(scores[:, :-1], -st.oc_model.rff.transform(x) @ st.oc_model.w.T, rtol=0, atol=1e-13)
    assert np.allclose(scores[:, -1], np.mean((AE.forward(st.ae_model.params, x)[0] - x) ** 2, axis=1), rtol=1e-12, atol=0)


def test_one_class_rounds_share_points_and_place_bins(spark):
    """Three ν of skewed rows took 16 rounds with bins around the last quantile
    and a hull for each ν of its own."""
    rng = np.random.default_rng(12)
    x = np.exp(rng.normal(size=(4000, 4)))
    df = spark.createDataFrame([(f"b{i}", *map(float, r)) for i, r in enumerate(x)], "row_id string, " + ", ".join(f"{c} double" for c in COLS))
    nus = (0.2, 0.15, 0.1)
    model = OC.fit(df, COLS, n_components=128, seed=2, nus=nus)
    z = OC._phi(model.rff)(x)
    for k, nu in enumerate(nus):
        best = plain_one_class(z, nu)
        assert best <= model.objective[k] + 1e-9 and model.objective[k] - best <= model.gap[k] <= OC.TOL * model.objective[k]
    assert model.rounds < 16
