"""Fold metrics (E4-E9, E12) and AUC (E7) on literal fixtures and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import metrics as M


def frame(spark, y, score, family="F1"):
    rows = [(f"r{i}", int(t), family if t == 1 else "Benign (Validation)", "val" if t == 0 else None, float(s))
            for i, (t, s) in enumerate(zip(y, score))]
    return spark.createDataFrame(rows, "row_id string, y int, family string, split string, score double")


def test_literal_fold(spark):
    df = frame(spark, [0, 0, 0, 1, 1], [.1, .4, .35, .8, .35])
    m = M.fold_metrics(df, {"c": F.col("score") > 0.37}, "family", scores={"c": F.col("score")}).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1, 1, 2, 1)
    assert m["accuracy"] == pytest.approx(.6)
    assert m["precision"] == pytest.approx(.5) and m["recall"] == pytest.approx(.5)
    assert m["f1_binary"] == pytest.approx(.5)
    assert m["f1_macro"] == pytest.approx(0.583333, abs=1e-6)
    assert m["fallout_fpr"] == pytest.approx(1 / 3) and m["specificity"] == pytest.approx(2 / 3)
    assert m["roc_auc"] == pytest.approx(.75)


def test_nothing_flagged(spark):
    df = frame(spark, [0, 0, 0, 1, 1], [.1, .2, .3, .4, .5])
    m = M.fold_metrics(df, {"c": F.lit(False)}, "family").first()
    assert m["precision"] == 0 and m["f1_binary"] == 0
    assert m["f1_macro"] == pytest.approx(.375)
    assert m["roc_auc"] is None


def test_macro_f1_empty(spark):
    df = frame(spark, [0, 0], [.1, .2])
    m = M.fold_metrics(df, {"c": F.col("score") > 1}, "family")
    assert m.count() == 0
    assert [tuple(r) for r in M.macro_f1(m, candidates=["c"]).collect()] == [("c", 0.0)]
    row = M.mean_fold(m, candidates=["c", "d"]).orderBy("candidate").collect()
    assert [(r["candidate"], r["macro_f1"], r["mean_fold_recall"]) for r in row] == [("c", 0.0, None), ("d", 0.0, None)]


def brute_auc(yb, sb, sa):
    tot = 0.0
    for a in sa:
        tot += sum(1.0 for b in sb if b < a) + 0.5 * sum(1.0 for b in sb if b == a)
    return tot / (len(sb) * len(sa))


def test_auc_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    rows = []
    ben = rng.integers(0, 20, 300).astype(float)
    fams = {"A": rng.integers(5, 25, 120).astype(float), "B": rng.integers(0, 20, 80).astype(float)}
    for i, s in enumerate(ben):
        rows.append((f"b{i}", 0, "Benign (Validation)", "val", float(s)))
    for f, arr in fams.items():
        for i, s in enumerate(arr):
            rows.append((f"{f}{i}", 1, f, None, float(s)))
    df = spark.createDataFrame(rows, "row_id string, y int, family string, split string, score double")
    got = {r["family"]: r["roc_auc"] for r in M.fold_auc(df, {"s": F.col("score")}, "family").collect()}
    for f, arr in fams.items():
        assert got[f] == pytest.approx(brute_auc(None, ben, arr), abs=1e-12)


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_range_sums_over_batches(monkeypatch, size):
    """However a range is cut into batches."""
    import pandas as pd
    import pyspark
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"c": rng.integers(0, 3, 400), "score": rng.integers(0, 9, 400).astype(float),
                         "family": rng.choice(["", "A", "B"], 400)})
    rows["family"] = rows["family"].replace("", None)
    rows.loc[rows["c"] == 2, "family"] = rows.loc[rows["c"] == 2, "family"].fillna("A")         # no benign rows
    counts = rows.groupby(["c", "score", "family"], dropna=False).size().rename("n").reset_index()
    counts = counts.sort_values(["c", "score", "family"], na_position="first")
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda _: type("T", (), {"partitionId": lambda self: 5})()))
    batches = (counts.iloc[i:i + size].reset_index(drop=True) for i in range(0, len(counts), size))
    got = {(r.c, r.family): (r.u, r.n) for r in pd.concat(M._range_sums(batches)).itertuples()}
    for (c, f), own in rows.groupby(["c", "family"], dropna=False):
        benign = rows[(rows["c"] == c) & rows["family"].isna()]["score"].to_numpy()
        u = 0.0 if pd.isna(f) else sum((benign < s).sum() + 0.5 * (benign == s).sum() for s in own["score"])
        assert got[c, None if pd.isna(f) else f] == (u, len(own))


def test_auc_of_many_candidates_is_one_scan(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, rng.integers(0, 2, 500), rng.normal(size=500).round(1)).withColumn(
        "other", F.when(F.col("score") < 1, -F.col("score"))).withColumn("none", F.lit(None).cast("double"))
    auc = M.fold_auc(df, {"s": F.col("score"), "o": F.col("other"), "n": F.col("none")}, "family")
    rows = {r["candidate"]: r["roc_auc"] for r in auc.collect()}
    pdf = df.toPandas()
    for name, col in (("s", "score"), ("o", "other")):
        own = pdf[pdf[col].notna()]
        assert rows[name] == pytest.approx(brute_auc(None, own[own.y == 0][col], own[own.y == 1][col]), abs=1e-12)
    assert "n" not in rows
    final = auc._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Scan ExistingRDD") == 2 and final.count("rangepartitioning") == 1       # the rows, and the names


def test_counts_with_benign_row(spark):
    df = frame(spark, [0, 0, 0, 1, 1], [.1, .2, .3, .4, .5])
    preds = {"a": F.col("score") > 0.25, "b": F.col("score") > 9}
    rows = {(r["candidate"], r["family"]): tuple(r[2:]) for r in M.fold_counts(df, preds, "family", benign_row=True).collect()}
    assert rows == {("a", "F1"): (3, 1, 2, 2), ("a", None): (3, 1, 0, 0), ("b", "F1"): (3, 0, 2, 0), ("b", None): (3, 0, 0, 0)}
    acc = {r[0]: r[1] for r in M.acceptance(M.fold_counts(df, preds, "family", benign_row=True)).collect()}
    assert acc == {r[0]: r[1] for r in M.benign_acceptance(df, preds).collect()}
    benign = df.where("y = 0")
    assert {r["family"] for r in M.fold_counts(benign, preds, "family", benign_row=True).collect()} == {None}


def test_candidates_in_one_pass(spark):
    df = frame(spark, [0, 0, 0, 1, 1, 1], [.1, .2, .3, .25, .5, .9])
    preds = {f"t{t}": F.col("score") > t for t in (.15, .28, .6)}
    m = {r["candidate"]: r for r in M.fold_metrics(df, preds, "family").collect()}
    assert m["t0.15"]["fp"] == 2 and m["t0.15"]["tp"] == 3
    assert m["t0.28"]["fp"] == 1 and m["t0.28"]["tp"] == 2
    assert m["t0.6"]["fp"] == 0 and m["t0.6"]["tp"] == 1
    acc = {r["candidate"]: r["benign_accuracy"] for r in M.summarize(M.fold_metrics(df, preds, "family")).collect()}
    assert acc["t0.15"] == pytest.approx(1 / 3)
