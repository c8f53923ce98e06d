"""Report tables.

Each table is a pivot over the study's count cube, which has a row for every
candidate and family and one for the benign validation rows; it is tens of
rows, and no table reads the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import BENIGN_REPORT_ROW
from . import metrics as M
from .sampling import AE_LINE_THRESHOLDS, AE_TABLE_THRESHOLDS

# Fixed operating points compared in the SVM-vs-AE per-class chart (ν, AE threshold).
OPERATING_POINTS = ((0.2, 0.15), (0.1, 0.1))


def col_name(prefix: str, v: float) -> str:
    return f"{prefix}_{str(v).replace('.', '_')}"


def class_order(df: DataFrame, col: str = "class") -> DataFrame:
    """Benign row first, then classes sorted."""
    return df.orderBy(F.when(F.col(col) == BENIGN_REPORT_ROW, 0).otherwise(1), F.col(col))


def _pct(c) -> F.Column:
    return F.round(F.lit(100.0) * c, 2)


def _by_class(st, candidates, metric: str = "accuracy") -> DataFrame:
    """(candidate, class, value): ``metric`` of each family, and the share of
    benign rows that are not flagged as the benign class."""
    rows = M.metrics_from_counts(st.cube.where(F.col("candidate").isin(list(candidates))))
    benign = F.col("family").isNull()
    accepted = (F.col("n_benign") - F.col("fp")) / F.when(F.col("n_benign") > 0, F.col("n_benign"))
    return (rows.select("candidate", F.coalesce("family", F.lit(BENIGN_REPORT_ROW)).alias("class"),
                        F.when(benign, accepted).otherwise(F.col(metric)).alias("value"))
            .where(F.col("value").isNotNull()))


def _wide(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per class with a percentage column per candidate."""
    return class_order(rows.groupBy("class").agg(*[
        F.max(F.when(F.col("candidate") == k, _pct(F.col("value")))).alias(v) for k, v in names.items()]))


def class_by_nu_table(st) -> DataFrame:
    """I1 (Table 2): accuracy % per class x ν; benign row = acceptance %."""
    names = {f"nu={nu}": col_name("nu", nu) for nu in st.nus}
    return _wide(_by_class(st, names), names)


def ae_table(st, metric: str) -> DataFrame:
    """I2 (Table 3): class x MSE threshold; ``metric`` accuracy or f1_macro.
    The benign row is the acceptance rate (score <= thr) for both versions."""
    names = {f"thr={t}": col_name("thr", t) for t in AE_TABLE_THRESHOLDS}
    return _wide(_by_class(st, names, metric), names)


def accuracy_series(st) -> DataFrame:
    """Per-class accuracy at the four line-plot thresholds (long form)."""
    m = st.metrics_of([f"thr={t}" for t in AE_LINE_THRESHOLDS])
    return m.select(F.col("family").alias("class"),
                    F.regexp_extract("candidate", r"thr=(.*)", 1).cast("double").alias("threshold"),
                    F.round("accuracy", 6).alias("accuracy"))


def operating_points(st) -> DataFrame:
    """I4: OC (ν) vs AE (threshold) accuracy per class at two operating points;
    either side may miss a class."""
    sides = F.array(*[F.struct(F.lit(f"nu={nu}|thr={thr}").alias("point"), F.lit(name).alias("candidate"), F.lit(side).alias("side"))
                      for nu, thr in OPERATING_POINTS for name, side in ((f"nu={nu}", "svm"), (f"thr={thr}", "ae"))])
    rows = _by_class(st, {n for nu, thr in OPERATING_POINTS for n in (f"nu={nu}", f"thr={thr}")})
    rows = rows.select("class", "value", "candidate", F.explode(sides).alias("s")).where("candidate = s.candidate")
    return rows.groupBy(F.col("s.point").alias("point"), "class").agg(*[
        F.max(F.when(F.col("s.side") == side, F.round("value", 6))).alias(f"{side}_accuracy") for side in ("svm", "ae")])


def topk_by_recall(metrics: DataFrame, k: int) -> DataFrame:
    """G1: top-k families by recall (family name breaks ties)."""
    return metrics.orderBy(F.col("recall").desc(), F.col("family")).limit(k)
