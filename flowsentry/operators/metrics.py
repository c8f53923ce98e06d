"""Zero-day fold evaluation without fold copies.

A fold is "all benign validation rows + one family's attack rows".  The
benign counts do not depend on the family, so instead of stacking the
validation set once per family and candidate (what a loop would do), one
grouped aggregate computes, for every candidate predicate at once:

* the benign-validation row: n_benign and flagged counts (fp), and
* one row per attack family: n_attack and flagged counts (tp).

The benign row is attached to the family rows by a window over that
(#families + 1)-row aggregate, so the data is scanned and shuffled once.
Everything after that is arithmetic on counts.

Exact ROC-AUC (E7) is a rank sum with ties counted half:
    AUC = sum_attack( #benign below + 1/2 #benign equal ) / (n_b * n_a)
computed for all candidates from one scan: one aggregate counts benign and
family rows per (candidate, score), one range partition orders the counts, and
each range gives its sums; the benign rows of the ranges below are added to
these few sums afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metric names of the published tables, in their order.
METRIC_COLUMNS = ["accuracy", "recall", "precision", "f1_binary", "f1_macro",
                  "specificity", "fallout_fpr", "roc_auc"]


def eval_rows(df: DataFrame, split_col: str = "split") -> DataFrame:
    """H2: benign validation rows plus every attack row."""
    return df.where((F.col("y") == 1) | (F.col(split_col) == "val"))


def fold_counts(df: DataFrame, preds: Mapping[str, Column], family_col: str,
                families: Sequence[str] | None = None, split_col: str = "split", benign_row: bool = False) -> DataFrame:
    """(candidate, family, n_benign, fp, n_attack, tp) for every candidate.

    ``preds`` maps candidate name -> 0/1 column.  ``families`` restricts the
    attack side (calibration / test families); benign rows are always the
    whole validation split.  With ``benign_row`` each candidate also has a row
    without a family, for the benign rows alone."""
    ev = eval_rows(df, split_col)
    if families is not None:
        ev = ev.where((F.col("y") == 0) | F.col(family_col).isin(list(families)))
    names = list(preds)
    fam = F.when(F.col("y") == 1, F.col(family_col)).otherwise(F.lit(None).cast("string"))
    aggs = [F.count(F.lit(1)).alias("n")] + [
        F.sum(preds[k].cast("long")).alias(f"c{i}") for i, k in enumerate(names)]
    g = ev.groupBy(F.col("y"), fam.alias("family")).agg(*aggs)
    # g has (#families + 1) rows; the benign row's counts are attached to every
    # family row with a window over that tiny table, so the data is scanned
    # and shuffled once (a self-join would re-run the aggregate per branch)
    whole = Window.partitionBy()
    benign_of = lambda c: F.max(F.when(F.col("y") == 0, F.col(c))).over(whole)
    j = g.select("*", benign_of("n").alias("n_benign"),
                 *[benign_of(f"c{i}").alias(f"b{i}") for i in range(len(names))])
    attack = F.col("y") == 1
    if not benign_row:
        j = j.where(attack)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(k).alias("candidate"), F.when(attack, F.col(f"c{i}")).alias("tp"), F.col(f"b{i}").alias("fp"))
        for i, k in enumerate(names)]))
    return j.select(
        F.col("family"),
        F.coalesce(F.col("n_benign"), F.lit(0)).alias("n_benign"),
        F.when(attack, F.col("n")).otherwise(F.lit(0)).alias("n_attack"),
        stacked.alias("s"),
    ).select(
        F.col("s.candidate").alias("candidate"), "family", "n_benign",
        F.coalesce(F.col("s.fp"), F.lit(0)).cast("long").alias("fp"),
        "n_attack", F.coalesce(F.col("s.tp"), F.lit(0)).cast("long").alias("tp"),
    )


def acceptance(counts: DataFrame) -> DataFrame:
    """E12 from ``fold_counts`` with its benign rows: (candidate,
    benign_accuracy)."""
    n = F.col("n_benign")
    return counts.where(F.col("family").isNull() & (n > 0)).select("candidate", ((n - F.col("fp")) / n).alias("benign_accuracy"))


def _div0(a: Column, b: Column) -> Column:
    """zero_division=0 semantics."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """E5 + E6 on (n_benign, fp, n_attack, tp)."""
    tp, fp = F.col("tp"), F.col("fp")
    tn = F.col("n_benign") - fp
    fn = F.col("n_attack") - tp
    n = F.col("n_benign") + F.col("n_attack")
    f1_pos = _div0(2 * tp, 2 * tp + fp + fn)
    f1_neg = _div0(2 * tn, 2 * tn + fn + fp)
    # f1_macro averages the classes present in truth or prediction
    has_neg = (F.col("n_benign") > 0) | ((tn + fn) > 0)
    has_pos = (F.col("n_attack") > 0) | ((tp + fp) > 0)
    n_cls = has_neg.cast("int") + has_pos.cast("int")
    f1_macro = _div0(F.when(has_neg, f1_neg).otherwise(0.0) + F.when(has_pos, f1_pos).otherwise(0.0), n_cls)
    neg_div = F.greatest(F.col("n_benign"), F.lit(1))
    return counts.select(
        "*",
        tn.alias("tn"), fn.alias("fn"),
        _div0(tp + tn, n).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        f1_pos.alias("f1_binary"),
        f1_macro.alias("f1_macro"),
        (fp.cast("double") / neg_div).alias("fallout_fpr"),
        F.when(F.col("n_benign") > 0, tn.cast("double") / neg_div).otherwise(0.0).alias("specificity"),
    )


def fold_metrics(df: DataFrame, preds: Mapping[str, Column], family_col: str,
                 families: Sequence[str] | None = None,
                 scores: Mapping[str, Column] | None = None) -> DataFrame:
    """per (candidate, family) metric rows; ``scores`` (candidate ->
    score column) adds roc_auc, null where a candidate has no score."""
    m = metrics_from_counts(fold_counts(df, preds, family_col, families))
    if scores:
        auc = fold_auc(df, scores, family_col, families)
        m = m.join(auc, ["candidate", "family"], "left")
    else:
        m = m.withColumn("roc_auc", F.lit(None).cast("double"))
    return m


def macro_f1(metrics: DataFrame, by: Sequence[str] = ("candidate",), candidates: Sequence[str] | None = None) -> DataFrame:
    """Mean f1_macro over families; with ``candidates``, 0.0 for one
    that has none."""
    if candidates is not None:
        metrics = for_all(candidates, metrics)
    return metrics.groupBy(*by).agg(F.coalesce(F.avg("f1_macro"), F.lit(0.0)).alias("macro_f1"))


def for_all(candidates: Sequence[str], metrics: DataFrame) -> DataFrame:
    """A row for every candidate: ones without a fold get a row of nulls."""
    names = metrics.sparkSession.createDataFrame([(c,) for c in candidates], "candidate string")
    return names.join(metrics, "candidate", "left")


def mean_fold(metrics: DataFrame, by: Sequence[str] = ("candidate",), candidates: Sequence[str] | None = None) -> DataFrame:
    """macro_f1 plus null-skipping means of the 8 fold metrics.  With
    ``candidates``, each of them has a row: macro_f1 0.0 and null means where
    the scope holds no family."""
    if candidates is not None:
        metrics = for_all(candidates, metrics)
    return metrics.groupBy(*by).agg(
        F.coalesce(F.avg("f1_macro"), F.lit(0.0)).alias("macro_f1"),
        *[F.avg(c).alias(f"mean_fold_{c}") for c in METRIC_COLUMNS])


def summarize(metrics: DataFrame, by: Sequence[str] = ("candidate",)) -> DataFrame:
    """Per candidate: macro-F1 and the benign acceptance rate, which equals
    1 - fp / n_benign on every family row of that candidate."""
    return metrics.groupBy(*by).agg(
        F.coalesce(F.avg("f1_macro"), F.lit(0.0)).alias("macro_f1"),
        F.max(F.when(F.col("n_benign") > 0, F.lit(1.0) - F.col("fp") / F.col("n_benign"))).alias("benign_accuracy"))


def benign_acceptance(df: DataFrame, preds: Mapping[str, Column], split_col: str = "split") -> DataFrame:
    """Share of benign validation rows not flagged, per candidate."""
    val = df.where(F.col(split_col) == "val")
    names = list(preds)
    row = val.agg(*[F.avg(F.lit(1) - preds[k].cast("int")).alias(f"a{i}") for i, k in enumerate(names)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("candidate"), F.col(f"a{i}").alias("benign_accuracy"))
        for i, k in enumerate(names)])).alias("s")).select("s.*")


# ------------------------------------------------------------------ AUC
def fold_auc(df: DataFrame, scores: Mapping[str, Column], family_col: str,
             families: Sequence[str] | None = None) -> DataFrame:
    """(candidate, family, roc_auc) by exact rank sum, ties counted half; null
    without benign or attack rows that have a score.  One scan of ``df``."""
    ev = eval_rows(df)
    if families is not None:
        ev = ev.where((F.col("y") == 0) | F.col(family_col).isin(list(families)))
    names = list(scores)
    family = F.when(F.col("y") == 1, F.coalesce(F.col(family_col), F.lit("")))
    counts = (ev.select(family.alias("family"), F.explode(F.array(*[
                  F.struct(F.lit(i).alias("c"), scores[k].cast("double").alias("score")) for i, k in enumerate(names)])).alias("s"))
              .where(F.col("s.score").isNotNull())
              .groupBy(F.col("s.c").alias("c"), F.col("s.score").alias("score"), "family").agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = counts.repartitionByRange(parts, "c", "score").sortWithinPartitions("c", "score", F.asc_nulls_first("family"))
    sums = ranged.mapInPandas(_range_sums, "p int, c int, family string, u double, n long")
    below = Window.partitionBy("c").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    benign = F.when(F.col("family").isNull(), F.col("n")).otherwise(0)
    res = (sums.withColumn("off", F.coalesce(F.sum(benign).over(below), F.lit(0))).withColumn("n_b", F.sum(benign).over(whole))
           .where(F.col("family").isNotNull()).groupBy("c", "family")
           .agg(F.sum(F.col("u") + F.col("n") * F.col("off")).alias("u"), F.sum("n").alias("n_a"), F.max("n_b").alias("n_b")))
    name_df = df.sparkSession.createDataFrame(list(enumerate(names)), "c int, candidate string")
    return res.join(F.broadcast(name_df), "c").select(
        "candidate", "family",
        F.when((F.col("n_b") > 0) & (F.col("n_a") > 0), F.col("u") / (F.col("n_b") * F.col("n_a"))).alias("roc_auc"))


def _range_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted range of (c, score, family, n), for each (c, family): the
    attack rows and the benign rows of this range that lie below them (equal
    ones half); a null family has the benign rows."""
    from pyspark import TaskContext
    total: dict[tuple, list] = {}
    at, seen = None, 0              # the candidate, and its benign rows so far
    tie, tied = None, 0             # the last benign (c, score), and its rows
    for pdf in batches:
        c, score, n = pdf["c"].to_numpy(), pdf["score"].to_numpy(), pdf["n"].to_numpy()
        family = pdf["family"].to_numpy()
        benign = pd.isna(family)
        held = np.where(benign, n, 0)
        upto = np.cumsum(held)
        first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        start = np.repeat(upto[first] - held[first], np.diff(np.append(first, len(c))))
        inside = upto - start + np.where((c == at) & (np.arange(len(c)) < (first[1] if len(first) > 1 else len(c))), seen, 0)
        last = np.maximum.accumulate(np.where(benign, np.arange(len(c)), -1))
        same = (last >= 0) & (c[last] == c) & (score[last] == score)
        equal = np.where(same, n[last], 0)
        if tie is not None:
            equal = np.where((last < 0) & (c == tie[0]) & (score == tie[1]), tied, equal)
        u = np.where(benign, 0.0, n * (inside - equal / 2.0))
        for key, x in pd.DataFrame({"c": c, "f": np.where(benign, "", "f" + pd.Series(family).fillna("").astype(str)), "u": u, "n": n}).groupby(["c", "f"]):
            own = total.setdefault(key, [0.0, 0])
            own[0] += float(x["u"].sum())
            own[1] += int(x["n"].sum())
        at, seen = c[-1], inside[-1]
        if last[-1] >= 0:
            tie, tied = (c[last[-1]], score[last[-1]]), n[last[-1]]
    if total:
        p = TaskContext.get().partitionId()
        yield pd.DataFrame([(p, int(c), f[1:] if f else None, u, n) for (c, f), (u, n) in total.items()], columns=["p", "c", "family", "u", "n"])
