"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code paths: the flow views, label
cascades, split buckets, pruning flags, medians/scalers, fold counts,
ASOF-join AUC and argmax selections are all re-derived here in SQL from the
raw driver tables (pre-registered views ``lineitem``, ``events``,
``embeddings``).  Training has no oracle; what trained models compute is
checked on written-down parameters (``literal_models``).
"""

from __future__ import annotations

from ..operators.sampling import (AE_LINE_THRESHOLDS, AE_TABLE_THRESHOLDS, AE_THR_QUANTILES,
                                  FUSION_Q, PAPER_MSE_THRESHOLDS, SVM_NU_VALUES, fusion_weight_grid)
from ..sources.tables import EVENT_LABEL_POOLS, LINEITEM_FEATURES, LINEITEM_LABELS
from . import literal_models

FEATS = LINEITEM_FEATURES
SEED = 42
DP = 6


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v))


def _md5_bucket(expr: str, tag: str, buckets: int = 10000) -> str:
    return f"(('0x' || substr(md5({expr} || ':{tag}'), 1, 8))::BIGINT % {buckets})"


def _md5_bits(expr: str, tag: str) -> str:
    return f"(('0x' || substr(md5({expr} || ':{tag}'), 1, 15))::BIGINT)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _label_ctes(src: str, out: str) -> str:
    """cic_label, y, attack_family, report_name from column ``label``."""
    cl = _strip("coalesce(label, 'nan')")
    fam_low = "lower(replace(cic_label, chr(0), ''))"
    rep_low = "replace(lower(cic_label), '_', ' ')"
    return f"""
{out}_c AS (SELECT *, {cl} AS cic_label FROM {src}),
{out} AS (SELECT *,
  CAST(CASE WHEN lower(cic_label) = 'benign' THEN 0 ELSE 1 END AS INTEGER) AS y,
  CASE WHEN {fam_low} = 'benign' THEN 'Benign'
       WHEN contains({fam_low}, 'heartbleed') THEN 'Heartbleed'
       WHEN contains({fam_low}, 'web attack') OR contains({fam_low}, 'webattack') THEN 'WebAttack'
       WHEN contains({fam_low}, 'portscan') THEN 'PortScan'
       WHEN contains({fam_low}, 'dos') AND NOT contains({fam_low}, 'ddos') THEN 'DoS'
       WHEN contains({fam_low}, 'ddos') THEN 'DDoS'
       WHEN contains({fam_low}, 'bot') THEN 'Bot'
       WHEN contains({fam_low}, 'infiltration') THEN 'Infiltration'
       ELSE replace(cic_label, chr(0), '') END AS attack_family,
  CASE WHEN {rep_low} = 'benign' THEN 'Benign (Validation)'
       WHEN contains({rep_low}, 'ftp') AND contains({rep_low}, 'patator') THEN 'FTP Bruteforce'
       WHEN contains({rep_low}, 'ssh') AND contains({rep_low}, 'patator') THEN 'SSH Bruteforce'
       WHEN contains({rep_low}, 'slowloris') THEN 'DoS (Slowloris)'
       WHEN contains({rep_low}, 'goldeneye') THEN 'DoS (GoldenEye)'
       WHEN contains({rep_low}, 'hulk') THEN 'DoS (Hulk)'
       WHEN contains({rep_low}, 'slowhttptest') OR contains({rep_low}, 'slowhttps') THEN 'DoS (Slowhttps)'
       WHEN contains({rep_low}, 'ddos') THEN 'DDoS'
       WHEN contains({rep_low}, 'dos') AND NOT contains({rep_low}, 'ddos') THEN 'DoS (other)'
       WHEN contains({rep_low}, 'heartbleed') THEN 'Heartbleed'
       WHEN contains({rep_low}, 'web') AND (contains({rep_low}, 'bf') OR contains({rep_low}, 'brute')) THEN 'Web BF'
       WHEN contains({rep_low}, 'xss') THEN 'Web XSS'
       WHEN contains({rep_low}, 'sql') THEN 'Web SQL'
       WHEN contains({rep_low}, 'infiltration') THEN 'Infiltration'
       WHEN contains({rep_low}, 'bot') THEN 'Botnet'
       WHEN contains({rep_low}, 'portscan') THEN 'PortScan'
       ELSE cic_label END AS report_name
FROM {out}_c)"""


def _clean(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def lineitem_ctes() -> str:
    """lf: the dirty lineitem flow view with labels (same rules as the Spark binding)."""
    lab = " ".join(f"WHEN l_returnflag || l_linestatus = '{k}' THEN '{v}'" for k, v in LINEITEM_LABELS.items())
    b = _md5_bucket("row_id", "dirt")
    inf = "'inf'::DOUBLE"
    return f"""
lf0 AS (SELECT
  concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
            CAST(l_linenumber AS VARCHAR)) AS row_id,
  'ship-' || CAST(year(l_shipdate) AS VARCHAR) AS src_file,
  l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
  l_extendedprice * (1.0 - l_discount) AS net,
  l_extendedprice * (1.0 - l_discount) * (1.0 + l_tax) AS gross,
  CASE WHEN l_returnflag = 'N' THEN 'BENIGN' {lab} ELSE l_returnflag || l_linestatus END AS label0
  FROM lineitem),
lf1 AS (SELECT *, {b} AS b FROM lf0),
lf2 AS (SELECT row_id, src_file,
  CASE WHEN b >= 30 AND b < 35 THEN -{inf} ELSE qty END AS qty,
  CASE WHEN b < 10 THEN {inf} ELSE price END AS price,
  CASE WHEN b >= 10 AND b < 20 THEN 'nan'::DOUBLE ELSE disc END AS disc,
  CASE WHEN b >= 20 AND b < 30 THEN NULL ELSE tax END AS tax,
  net, gross,
  CASE WHEN b >= 35 AND b < 40 THEN NULL
       WHEN b >= 40 AND b < 60 AND label0 = 'BENIGN' THEN ' BENIGN '
       ELSE label0 END AS label
  FROM lf1),
lf3 AS (SELECT row_id, src_file, {", ".join(f"{_clean(f)} AS {f}" for f in FEATS)}, label FROM lf2),
{_label_ctes("lf3", "lf")}"""


def split_ctes() -> str:
    """sp: lf + split (benign complete rows, md5 bucket < 7500 -> train)."""
    complete = " AND ".join(f"{f} IS NOT NULL" for f in FEATS)
    b = _md5_bucket("row_id", str(SEED))
    return f"""
sp AS (SELECT *, CASE WHEN y = 0 AND {complete} AND attack_family IS NOT NULL AND cic_label IS NOT NULL
          THEN CASE WHEN {b} < 7500 THEN 'train' ELSE 'val' END END AS split FROM lf)"""


def prep_ctes() -> str:
    """corr-based keep flags, medians, means, stds; z-scores; scored rows."""
    pairs = [(i, j) for i in range(len(FEATS)) for j in range(i + 1, len(FEATS))]
    corr_cols = ", ".join(f"corr({FEATS[i]}, {FEATS[j]}) AS r_{i}_{j}" for i, j in pairs)
    keep = []
    for j in range(len(FEATS)):
        conds = [f"coalesce(abs(r_{i}_{j}) > 0.9, false)" for i in range(j)]
        keep.append(f"CASE WHEN {' OR '.join(conds) if conds else 'false'} THEN 0 ELSE 1 END AS k_{j}")
    med = ", ".join(f"quantile_cont({f}, 0.5) AS med_{i}" for i, f in enumerate(FEATS))
    imp = ", ".join(f"coalesce({f}, (SELECT med_{i} FROM stats_m)) AS {f}" for i, f in enumerate(FEATS))
    mom = ", ".join(f"avg({f}) AS mu_{i}, stddev_pop({f}) AS sd_{i}" for i, f in enumerate(FEATS))
    z = ", ".join(
        f"(coalesce(sp.{f}, med_{i}) - mu_{i}) / (CASE WHEN sd_{i} > 0 THEN sd_{i} ELSE 1.0 END) AS z_{i}"
        for i, f in enumerate(FEATS))
    nk = " + ".join(f"k_{i}" for i in range(len(FEATS)))
    zsq = "(" + " + ".join(f"k_{i} * z_{i} * z_{i}" for i in range(len(FEATS))) + f") / ({nk})"
    zmax = "greatest(" + ", ".join(f"CASE WHEN k_{i} = 1 THEN abs(z_{i}) ELSE 0.0 END" for i in range(len(FEATS))) + ")"
    return f"""
corr_t AS (SELECT {corr_cols} FROM sp WHERE split = 'train'),
keep_t AS (SELECT {", ".join(keep)} FROM corr_t),
stats_m AS (SELECT {med} FROM sp WHERE split = 'train'),
imp_t AS (SELECT {imp} FROM sp WHERE split = 'train'),
stats_s AS (SELECT {mom} FROM imp_t),
zt AS (SELECT sp.row_id, sp.y, sp.report_name AS family, sp.split, {z}
       FROM sp, stats_m, stats_s WHERE sp.y = 1 OR sp.split IS NOT NULL),
scored AS (SELECT row_id, y, family, split, {zmax} AS ml_raw, {zsq} AS ae FROM zt, keep_t)"""


def base() -> str:
    return "WITH " + ",".join([lineitem_ctes(), split_ctes(), prep_ctes()])


def _r(x: str, dp: int = DP) -> str:
    return f"round({x}, {dp})"


# ------------------------------------------------------------------ fold metrics templates
def counts_cte(name: str, preds: dict[str, str], families: list[str] | None = None) -> str:
    """name: (candidate, family, n_benign, fp, n_attack, tp) via per-candidate union."""
    fam_filter = "" if families is None else " AND family IN (" + ", ".join(_lit(f) for f in families) + ")"
    parts = []
    for cand, pred in preds.items():
        parts.append(f"""SELECT {_lit(cand)} AS candidate, a.family, coalesce(b.n_benign, 0) AS n_benign,
  coalesce(b.fp, 0) AS fp, a.n_attack, a.tp FROM
  (SELECT family, count(*) AS n_attack, CAST(sum(CASE WHEN {pred} THEN 1 ELSE 0 END) AS BIGINT) AS tp
     FROM scored WHERE y = 1{fam_filter} GROUP BY family) a
  LEFT JOIN (SELECT count(*) AS n_benign, CAST(sum(CASE WHEN {pred} THEN 1 ELSE 0 END) AS BIGINT) AS fp
     FROM scored WHERE y = 0 AND split = 'val') b ON TRUE""")
    return f"{name} AS (" + "\nUNION ALL\n".join(parts) + ")"


def metrics_cte(name: str, counts: str) -> str:
    tn = "(n_benign - fp)"
    fn = "(n_attack - tp)"
    f1p = f"CASE WHEN 2*tp + fp + {fn} = 0 THEN 0.0 ELSE 2.0*tp / (2*tp + fp + {fn}) END"
    f1n = f"CASE WHEN 2*{tn} + {fn} + fp = 0 THEN 0.0 ELSE 2.0*{tn} / (2*{tn} + {fn} + fp) END"
    has_neg = f"(n_benign > 0 OR {tn} + {fn} > 0)"
    has_pos = f"(n_attack > 0 OR tp + fp > 0)"
    ncls = f"(CAST({has_neg} AS INTEGER) + CAST({has_pos} AS INTEGER))"
    f1m = (f"CASE WHEN {ncls} = 0 THEN 0.0 ELSE ((CASE WHEN {has_neg} THEN {f1n} ELSE 0.0 END) + "
           f"(CASE WHEN {has_pos} THEN {f1p} ELSE 0.0 END)) / {ncls} END")
    return f"""{name} AS (SELECT candidate, family, n_benign, n_attack, tp, fp, {tn} AS tn, {fn} AS fn,
  CASE WHEN n_benign + n_attack = 0 THEN 0.0 ELSE (tp + {tn}) * 1.0 / (n_benign + n_attack) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision,
  CASE WHEN tp + {fn} = 0 THEN 0.0 ELSE tp * 1.0 / (tp + {fn}) END AS recall,
  {f1p} AS f1_binary, {f1m} AS f1_macro,
  fp * 1.0 / greatest(n_benign, 1) AS fallout_fpr,
  CASE WHEN n_benign > 0 THEN {tn} * 1.0 / greatest(n_benign, 1) ELSE 0.0 END AS specificity
  FROM {counts})"""


def auc_cte(name: str, scores: dict[str, str], families: list[str] | None = None) -> str:
    """(candidate, family, roc_auc) by ASOF join on the benign cumulative counts."""
    fam_filter = "" if families is None else " AND family IN (" + ", ".join(_lit(f) for f in families) + ")"
    parts = []
    for cand, sc in scores.items():
        parts.append(f"""SELECT {_lit(cand)} AS candidate, a.family,
  sum(a.na * (coalesce(c.le, 0) - CASE WHEN c.s = a.s THEN c.nb ELSE 0 END / 2.0))
    / (max(t.n_b) * sum(a.na)) AS roc_auc
FROM (SELECT family, {sc} AS s, count(*) AS na FROM scored WHERE y = 1{fam_filter} GROUP BY ALL) a
ASOF LEFT JOIN (SELECT s, nb, sum(nb) OVER (ORDER BY s) AS le
      FROM (SELECT {sc} AS s, count(*) AS nb FROM scored WHERE y = 0 AND split = 'val' GROUP BY ALL)) c
  ON a.s >= c.s
CROSS JOIN (SELECT count(*) AS n_b FROM scored WHERE y = 0 AND split = 'val') t
GROUP BY a.family""")
    return f"{name} AS (" + "\nUNION ALL\n".join(parts) + ")"


METRIC_OUT = ["accuracy", "precision", "recall", "f1_binary", "f1_macro", "fallout_fpr", "specificity"]


def metric_select(src: str, extra: str = "", auc: str = "roc_auc") -> str:
    cols = ", ".join(f"{_r(c)} AS {c}" for c in METRIC_OUT)
    return (f"SELECT {extra}family, n_benign, n_attack, tp, fp, tn, fn, {cols}, "
            f"{_r(auc) if auc != 'NULL' else 'CAST(NULL AS DOUBLE)'} AS roc_auc FROM {src}")


# ------------------------------------------------------------------ selections
def _nu_bound(nu: float) -> str:
    return f"(SELECT quantile_cont(ml_raw, {1.0 - nu!r}) FROM scored WHERE split = 'train')"


def _ml_dec(nu_expr: str) -> str:
    return f"(ml_raw - {nu_expr})"


def nu_ctes() -> str:
    """bounds per ν, fold metrics for all ν, macro-F1, best ν (first best)."""
    preds = {f"nu={nu}": f"{_ml_dec(_nu_bound(nu))} > 0" for nu in SVM_NU_VALUES}
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(preds))
    bounds = " UNION ALL ".join(f"SELECT {nu!r}::DOUBLE AS nu, {_nu_bound(nu)} AS bnd" for nu in SVM_NU_VALUES)
    return f""",
{counts_cte('nu_cnt', preds)},
{metrics_cte('nu_m', 'nu_cnt')},
nu_mf AS (SELECT candidate, CAST(regexp_extract(candidate, 'nu=(.*)', 1) AS DOUBLE) AS nu,
                 coalesce(avg(f1_macro), 0.0) AS macro_f1,
                 CASE candidate {order} END AS ord FROM nu_m GROUP BY candidate),
best_nu AS (SELECT nu FROM nu_mf ORDER BY macro_f1 DESC, ord LIMIT 1),
nu_bounds AS ({bounds}),
bound AS (SELECT bnd FROM nu_bounds WHERE nu = (SELECT nu FROM best_nu))"""


def thr_ctes() -> str:
    """AE-style threshold grid from fixed values and val quantiles; sweep; best."""
    fixed = " UNION ".join(f"SELECT {t!r} AS t" for t in PAPER_MSE_THRESHOLDS)
    qs = " UNION ".join(
        f"SELECT round((SELECT quantile_cont(ae, {q!r}) FROM scored WHERE split = 'val'), 8)" for q in AE_THR_QUANTILES)
    return f""",
grid AS (SELECT DISTINCT round(CAST(t AS DOUBLE), 8) AS t FROM ({fixed} UNION {qs})),
thr_cnt AS (SELECT g.t AS threshold, a.family, coalesce(b.n_benign, 0) AS n_benign, coalesce(b.fp, 0) AS fp,
    a.n_attack, a.tp
  FROM grid g,
  LATERAL (SELECT family, count(*) AS n_attack, CAST(sum(CASE WHEN ae > g.t THEN 1 ELSE 0 END) AS BIGINT) AS tp
           FROM scored WHERE y = 1 GROUP BY family) a
  LEFT JOIN LATERAL (SELECT count(*) AS n_benign, CAST(sum(CASE WHEN ae > g.t THEN 1 ELSE 0 END) AS BIGINT) AS fp
           FROM scored WHERE y = 0 AND split = 'val') b ON TRUE),
thr_c2 AS (SELECT CAST(threshold AS VARCHAR) AS candidate, threshold, family, n_benign, fp, n_attack, tp FROM thr_cnt),
{metrics_cte('thr_m0', 'thr_c2')},
thr_m AS (SELECT m.*, c.threshold FROM thr_m0 m JOIN (SELECT DISTINCT candidate, threshold FROM thr_c2) c USING (candidate)),
thr_mf AS (SELECT threshold, coalesce(avg(f1_macro), 0.0) AS macro_f1 FROM thr_m GROUP BY threshold),
best_thr AS (SELECT threshold FROM thr_mf ORDER BY macro_f1 DESC, threshold LIMIT 1)"""


def fusion_ctes() -> str:
    """robust refs on val, fused candidates, q .92 thresholds, calibration macro-F1, best."""
    weights = " UNION ALL ".join(
        f"SELECT {i} AS ord, {ws!r}::DOUBLE AS w_svm, {wa!r}::DOUBLE AS w_ae" for i, (ws, wa) in enumerate(fusion_weight_grid()))
    q = FUSION_Q[0]
    svm = "(ml_raw - (SELECT bnd FROM bound))"
    return f""",
refs0 AS (SELECT quantile_cont({svm}, 0.5) AS m_svm, quantile_cont(ae, 0.5) AS m_ae FROM scored WHERE split = 'val'),
refs AS (SELECT m_svm, quantile_cont(abs({svm} - m_svm), 0.5) + 1e-9 AS d_svm,
                m_ae, quantile_cont(abs(ae - m_ae), 0.5) + 1e-9 AS d_ae
         FROM scored, refs0 WHERE split = 'val' GROUP BY m_svm, m_ae),
zs AS (SELECT s.*, ({svm} - m_svm) / d_svm AS z_svm, (ae - m_ae) / d_ae AS z_ae FROM scored s, refs),
wts AS ({weights}),
fthr AS (SELECT w.ord, w.w_svm, w.w_ae, {q!r}::DOUBLE AS thr_quantile,
           quantile_cont(w.w_svm * z.z_svm + w.w_ae * z.z_ae, {q!r}) AS thr
         FROM wts w, zs z WHERE z.split = 'val' GROUP BY w.ord, w.w_svm, w.w_ae),
fus_cnt AS (SELECT f.ord, a.family, coalesce(b.n_benign, 0) AS n_benign, coalesce(b.fp, 0) AS fp, a.n_attack, a.tp
  FROM fthr f,
  LATERAL (SELECT family, count(*) AS n_attack,
                  CAST(sum(CASE WHEN f.w_svm * z_svm + f.w_ae * z_ae > f.thr THEN 1 ELSE 0 END) AS BIGINT) AS tp
           FROM zs WHERE y = 1 AND family IN (SELECT family FROM calib) GROUP BY family) a
  LEFT JOIN LATERAL (SELECT count(*) AS n_benign,
                  CAST(sum(CASE WHEN f.w_svm * z_svm + f.w_ae * z_ae > f.thr THEN 1 ELSE 0 END) AS BIGINT) AS fp
           FROM zs WHERE y = 0 AND split = 'val') b ON TRUE),
fus_c2 AS (SELECT CAST(ord AS VARCHAR) AS candidate, * EXCLUDE (ord) FROM fus_cnt),
{metrics_cte('fus_m', 'fus_c2')},
fus_mf AS (SELECT CAST(candidate AS INTEGER) AS ord, avg(f1_macro) AS macro_f1_calib FROM fus_m GROUP BY candidate),
fus AS (SELECT f.*, m.macro_f1_calib FROM fthr f JOIN fus_mf m USING (ord)),
best_fus AS (SELECT * FROM fus ORDER BY macro_f1_calib DESC, ord LIMIT 1)"""


#: Fixed value: calibration families of the five attack families of the lineitem view (seed 42, half of them).
CALIBRATION = ("PortScan", "nan")


def calib_ctes() -> str:
    """Calibration / test family roles, as written down above."""
    names = ", ".join(f"({_lit(n)})" for n in CALIBRATION)
    return f""",
calib AS (SELECT * FROM (VALUES {names}) v(family)),
test AS (SELECT DISTINCT family FROM scored WHERE y = 1 AND family NOT IN (SELECT family FROM calib))"""


def study_sql() -> str:
    return base() + nu_ctes() + thr_ctes() + calib_ctes() + fusion_ctes()


def ablation_ctes() -> str:
    tf = "family IN (SELECT family FROM test)"
    return f""",
abl_pts AS (
  SELECT 'ML_only_OC_SVM' AS model, family, y, split, CASE WHEN ml_raw - (SELECT bnd FROM bound) >= 0 THEN 1 ELSE 0 END AS pred,
         CAST(NULL AS DOUBLE) AS s FROM zs WHERE (y = 0 AND split = 'val') OR (y = 1 AND {tf})
  UNION ALL
  SELECT 'DL_only_AE', family, y, split, CASE WHEN ae > (SELECT threshold FROM best_thr) THEN 1 ELSE 0 END, ae
         FROM zs WHERE (y = 0 AND split = 'val') OR (y = 1 AND {tf})
  UNION ALL
  SELECT 'Hybrid_fusion', family, y, split,
         CASE WHEN b.w_svm * z_svm + b.w_ae * z_ae > b.thr THEN 1 ELSE 0 END, b.w_svm * z_svm + b.w_ae * z_ae
         FROM zs, best_fus b WHERE (y = 0 AND split = 'val') OR (y = 1 AND {tf})),
abl_cnt AS (SELECT a.model AS candidate, a.family, coalesce(b.n_benign, 0) AS n_benign, coalesce(b.fp, 0) AS fp,
                   a.n_attack, a.tp
  FROM (SELECT model, family, count(*) AS n_attack, CAST(sum(pred) AS BIGINT) AS tp FROM abl_pts WHERE y = 1 GROUP BY ALL) a
  LEFT JOIN (SELECT model, count(*) AS n_benign, CAST(sum(pred) AS BIGINT) AS fp FROM abl_pts WHERE y = 0 GROUP BY ALL) b
  USING (model)),
{metrics_cte('abl_m0', 'abl_cnt')},
abl_auc AS (
  SELECT a.model AS candidate, a.family,
    sum(a.na * (coalesce(c.le, 0) - CASE WHEN c.s = a.s THEN c.nb ELSE 0 END / 2.0)) / (max(t.n_b) * sum(a.na)) AS roc_auc
  FROM (SELECT model, family, s, count(*) AS na FROM abl_pts WHERE y = 1 AND s IS NOT NULL GROUP BY ALL) a
  ASOF LEFT JOIN (SELECT model, s, nb, sum(nb) OVER (PARTITION BY model ORDER BY s) AS le
        FROM (SELECT model, s, count(*) AS nb FROM abl_pts WHERE y = 0 AND s IS NOT NULL GROUP BY ALL)) c
    ON a.model = c.model AND a.s >= c.s
  JOIN (SELECT model, count(*) AS n_b FROM abl_pts WHERE y = 0 AND s IS NOT NULL GROUP BY ALL) t ON t.model = a.model
  GROUP BY a.model, a.family),
abl_m AS (SELECT m.*, u.roc_auc FROM abl_m0 m LEFT JOIN abl_auc u USING (candidate, family)),
abl AS (SELECT candidate AS model, coalesce(avg(f1_macro), 0.0) AS macro_f1,
    avg(accuracy) AS mean_fold_accuracy, avg(recall) AS mean_fold_recall, avg(precision) AS mean_fold_precision,
    avg(f1_binary) AS mean_fold_f1_binary, avg(f1_macro) AS mean_fold_f1_macro,
    avg(specificity) AS mean_fold_specificity, avg(fallout_fpr) AS mean_fold_fallout_fpr,
    avg(roc_auc) AS mean_fold_roc_auc FROM abl_m GROUP BY candidate)"""


# ------------------------------------------------------------------ event label view
def events_ctes() -> str:
    parts = []
    for et, pool in EVENT_LABEL_POOLS.items():
        arr = "[" + ", ".join("CAST(NULL AS VARCHAR)" if v is None else _lit(v) for v in pool) + "]"
        parts.append(f"WHEN event_type = '{et}' THEN {arr}[({_md5_bucket('CAST(event_id AS VARCHAR)', 'label')} % {len(pool)}) + 1]")
    return f"""WITH ev0 AS (SELECT CAST(event_id AS VARCHAR) AS row_id, 'events' AS src_file, value,
  CASE {" ".join(parts)} ELSE event_type END AS label FROM events),
{_label_ctes("ev0", "ev")}"""


# ------------------------------------------------------------------ catalog
def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    ev = events_ctes()
    out["label_binary"] = ev + " SELECT row_id, cic_label, y, attack_family, report_name FROM ev"
    out["family_counts"] = ev + " SELECT attack_family, y, count(*) AS n FROM ev GROUP BY ALL"
    out["report_name_counts"] = ev + " SELECT report_name, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_attack FROM ev GROUP BY ALL"

    lf = "WITH " + lineitem_ctes()
    unp = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x FROM lf" for f in FEATS)
    out["clean_nonfinite"] = lf + f""", u AS ({unp})
SELECT feature, count(*) AS n_rows, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       round(sum(x), 2) AS total FROM u GROUP BY feature"""
    sp = "WITH " + lineitem_ctes() + "," + split_ctes()
    out["drop_missing_benign"] = sp + """
SELECT y, count(*) AS n_rows, count(split) AS n_complete_benign FROM sp GROUP BY y"""
    out["train_val_split"] = sp + " SELECT row_id, split FROM sp WHERE split IS NOT NULL"
    out["row_counts"] = sp + """
SELECT count(*) AS loaded, count(*) FILTER (WHERE y = 0) AS benign, count(split) AS benign_complete,
       count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val FROM sp"""
    out["fit_sample_topk"] = sp + f"""
SELECT row_id FROM sp WHERE split = 'train' ORDER BY {_md5_bits('row_id', 'fit42')}, row_id LIMIT 10000"""
    out["quota_sample"] = lf + f""",
nf AS (SELECT count(DISTINCT src_file) AS n FROM lf),
q AS (SELECT CAST(ceil(floor(20000 * 0.65) / n) AS BIGINT) AS qb,
             CAST(ceil((20000 - floor(20000 * 0.65)) / n) AS BIGINT) AS qa FROM nf),
r AS (SELECT row_id, src_file, y, row_number() OVER (PARTITION BY src_file, y
        ORDER BY {_md5_bits('row_id', '42')}, row_id) AS rn FROM lf)
SELECT row_id, src_file, y FROM r, q WHERE rn <= CASE WHEN y = 0 THEN qb ELSE qa END"""
    out["quota_sample_repeats"] = lf + f""",
nf AS (SELECT count(DISTINCT src_file) AS n FROM lf),
q AS (SELECT CAST(ceil(floor(20000 * 0.65) / n) AS BIGINT) AS qb,
             CAST(ceil((20000 - floor(20000 * 0.65)) / n) AS BIGINT) AS qa FROM nf)
SELECT src_file, y, least(count(*), max(CASE WHEN y = 0 THEN qb ELSE qa END)) AS n FROM lf, q GROUP BY src_file, y"""

    st = study_sql()
    pairs = [(i, j) for i in range(len(FEATS)) for j in range(i + 1, len(FEATS))]
    corr_rows = " UNION ALL ".join(
        f"SELECT '{FEATS[i]}' AS a, '{FEATS[j]}' AS b, round(r_{i}_{j}, 6) AS r FROM corr_t" for i, j in pairs)
    out["corr_matrix"] = base() + f" {corr_rows}"
    pf = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, k_{i} = 1 AS kept,
  CASE WHEN k_{i} = 1 THEN round(med_{i}, 6) END AS median,
  CASE WHEN k_{i} = 1 THEN round(mu_{i}, 6) END AS mean,
  CASE WHEN k_{i} = 1 THEN round(sd_{i}, 6) END AS std FROM keep_t, stats_m, stats_s"""
        for i, f in enumerate(FEATS))
    out["preprocess_fit"] = base() + " " + pf
    zl = " UNION ALL ".join(
        f"SELECT row_id, split, '{f}' AS feature, round(z_{i}, 6) AS z FROM zt, keep_t WHERE k_{i} = 1"
        for i, f in enumerate(FEATS))
    out["impute_scale"] = base() + " " + zl

    out["corr_prune"] = base() + " " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, k_{i} = 0 AS dropped FROM keep_t" for i, f in enumerate(FEATS))
    out["fit_medians"] = base() + " " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(med_{i}, 6) AS median FROM stats_m, keep_t WHERE k_{i} = 1"
        for i, f in enumerate(FEATS))
    out["fit_scaler"] = base() + " " + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(mu_{i}, 6) AS mean, round(sd_{i}, 6) AS std,
  round(CASE WHEN sd_{i} > 0 THEN sd_{i} ELSE 1.0 END, 6) AS scale FROM stats_s, keep_t WHERE k_{i} = 1"""
        for i, f in enumerate(FEATS))
    # reindex: the frame lacks 'tax' (all missing -> median); kept features only
    out["reindex_impute"] = base() + " " + " UNION ALL ".join(
        f"SELECT lf.row_id, '{f}' AS feature, round(coalesce({'NULL::DOUBLE' if f == 'tax' else 'lf.' + f}, med_{i}), 6)"
        f" AS value FROM lf, stats_m, keep_t WHERE k_{i} = 1" for i, f in enumerate(FEATS))

    q95 = "(SELECT quantile_cont(ae, 0.95) FROM scored WHERE split = 'val')"
    fc = base() + ",\n" + counts_cte("c", {"ae_q95": f"ae > {q95}"})
    out["fold_confusion"] = fc + " SELECT family, n_benign, fp, n_attack, tp FROM c"
    out["fold_metrics"] = (fc + ",\n" + metrics_cte("m", "c") + ",\n" + auc_cte("a", {"ae_q95": "ae"}) +
                           ", mm AS (SELECT m.*, a.roc_auc FROM m LEFT JOIN a USING (candidate, family)) " +
                           metric_select("mm"))
    out["fold_auc"] = (base() + ",\n" + auc_cte("a", {"zsq": "ae", "zmax": "ml_raw"}) +
                       " SELECT candidate, family, round(roc_auc, 6) AS roc_auc FROM a")
    nu = base() + nu_ctes()
    out["macro_f1"] = nu + " SELECT nu, round(macro_f1, 6) AS macro_f1 FROM nu_mf"
    bounds = " UNION ALL ".join(
        f"SELECT {nu_!r}::DOUBLE AS nu, {_nu_bound(nu_)} AS bnd, {i} AS ord" for i, nu_ in enumerate(SVM_NU_VALUES))
    out["ocsvm_nu_sweep"] = nu + f""", bs AS ({bounds}),
acc AS (SELECT bs.nu, avg(CASE WHEN ml_raw - bs.bnd > 0 THEN 0.0 ELSE 1.0 END) AS benign_accuracy
        FROM scored, bs WHERE split = 'val' GROUP BY bs.nu)
SELECT bs.nu, round(bs.bnd, 6) AS boundary, round(nu_mf.macro_f1, 6) AS macro_f1,
       round(acc.benign_accuracy, 6) AS benign_accuracy
FROM bs JOIN nu_mf ON nu_mf.nu = bs.nu JOIN acc ON acc.nu = bs.nu"""
    qrows = " UNION ALL ".join(
        f"SELECT '{c}' AS score, {q!r}::DOUBLE AS q, round(quantile_cont({c}, {q!r}), 6) AS value FROM scored WHERE split = 'val'"
        for c in ("ae", "ml_raw") for q in (0.9, 0.92, 0.95))
    out["quantile_thresholds"] = base() + " " + qrows
    th = base() + thr_ctes()
    out["threshold_sweep"] = th + """,
acc AS (SELECT g.t AS threshold, avg(CASE WHEN ae > g.t THEN 0.0 ELSE 1.0 END) AS benign_accuracy
        FROM grid g, scored WHERE split = 'val' GROUP BY g.t)
SELECT threshold, round(macro_f1, 6) AS macro_f1, round(benign_accuracy, 6) AS benign_accuracy
FROM thr_mf JOIN acc USING (threshold)"""
    out["best_threshold"] = th + " " + metric_select(
        "thr_m WHERE threshold = (SELECT threshold FROM best_thr)", extra="threshold, ", auc="NULL")
    out["topk_recall"] = th + " " + metric_select(
        "thr_m WHERE threshold = (SELECT threshold FROM best_thr)", auc="NULL") + " ORDER BY recall DESC, family LIMIT 3"

    out["robust_ref"] = st + """
SELECT 'svm' AS score, round(m_svm, 6) AS median, round(d_svm, 6) AS mad FROM refs
UNION ALL SELECT 'ae', round(m_ae, 6), round(d_ae, 6) FROM refs"""
    out["fused_score"] = st + """
SELECT row_id, round(z_svm, 6) AS z_svm, round(z_ae, 6) AS z_ae, round(0.5 * z_svm + 0.5 * z_ae, 6) AS fused FROM zs"""
    out["fusion_calibration"] = st + """,
bf AS (SELECT ord FROM best_fus)
SELECT w_svm, w_ae, thr_quantile, round(thr, 6) AS thr, round(macro_f1_calib, 6) AS macro_f1_calib,
       ord = (SELECT ord FROM bf) AS chosen FROM fus"""
    out["hybrid_deploy"] = st + """
SELECT row_id, round(b.w_svm * z_svm + b.w_ae * z_ae, 6) AS z,
       CASE WHEN b.w_svm * z_svm + b.w_ae * z_ae > b.thr THEN 1 ELSE 0 END AS pred
FROM zs, best_fus b WHERE y = 1 OR split = 'val'"""
    out["calib_test_families"] = st + """
SELECT s.family, count(*) AS n_attack,
       CASE WHEN s.family IN (SELECT family FROM calib) THEN 'calibration' ELSE 'test' END AS role
FROM scored s WHERE y = 1 GROUP BY s.family"""
    ab = st + ablation_ctes()
    mcols = ", ".join(f"round(mean_fold_{c}, 6) AS mean_fold_{c}" for c in
                      ["accuracy", "recall", "precision", "f1_binary", "f1_macro", "specificity", "fallout_fpr", "roc_auc"])
    out["ablation_summary"] = ab + f" SELECT model, round(macro_f1, 6) AS macro_f1, {mcols} FROM abl"
    out["ablation_delta"] = ab + """
SELECT round(max(CASE WHEN model = 'Hybrid_fusion' THEN macro_f1 END) - max(CASE WHEN model = 'ML_only_OC_SVM' THEN macro_f1 END), 6) AS hybrid_minus_ml,
       round(max(CASE WHEN model = 'Hybrid_fusion' THEN macro_f1 END) - max(CASE WHEN model = 'DL_only_AE' THEN macro_f1 END), 6) AS hybrid_minus_dl,
       round(max(CASE WHEN model = 'ML_only_OC_SVM' THEN macro_f1 END) - max(CASE WHEN model = 'DL_only_AE' THEN macro_f1 END), 6) AS ml_minus_dl
FROM abl"""

    # report tables
    nu_cols = ", ".join(
        f"max(CASE WHEN candidate = 'nu={v}' THEN round(100.0 * accuracy, 2) END) AS nu_{str(v).replace('.', '_')}"
        for v in SVM_NU_VALUES)
    nu_ben = ", ".join(
        f"round(100.0 * avg(CASE WHEN {_ml_dec(_nu_bound(v))} > 0 THEN 0.0 ELSE 1.0 END), 2) AS nu_{str(v).replace('.', '_')}"
        for v in SVM_NU_VALUES)
    out["table_class_by_nu"] = nu + f"""
SELECT family AS class, {nu_cols} FROM nu_m GROUP BY family
UNION ALL SELECT 'Benign (Validation)', {nu_ben} FROM scored WHERE split = 'val'"""
    for key, metric in (("table3_acc", "accuracy"), ("table3_f1", "f1_macro")):
        preds = {f"thr={t}": f"ae > {t!r}" for t in AE_TABLE_THRESHOLDS}
        cols = ", ".join(f"max(CASE WHEN candidate = 'thr={t}' THEN round(100.0 * {metric}, 2) END) AS thr_{str(t).replace('.', '_')}"
                         for t in AE_TABLE_THRESHOLDS)
        ben = ", ".join(f"round(100.0 * avg(CASE WHEN ae > {t!r} THEN 0.0 ELSE 1.0 END), 2) AS thr_{str(t).replace('.', '_')}"
                        for t in AE_TABLE_THRESHOLDS)
        out[key] = (base() + ",\n" + counts_cte("c", preds) + ",\n" + metrics_cte("m", "c") +
                    f" SELECT family AS class, {cols} FROM m GROUP BY family"
                    f" UNION ALL SELECT 'Benign (Validation)', {ben} FROM scored WHERE split = 'val'")
    preds = {f"thr={t}": f"ae > {t!r}" for t in AE_LINE_THRESHOLDS}
    out["accuracy_series"] = (base() + ",\n" + counts_cte("c", preds) + ",\n" + metrics_cte("m", "c") +
                              " SELECT family AS class, CAST(regexp_extract(candidate, 'thr=(.*)', 1) AS DOUBLE) AS threshold,"
                              " round(accuracy, 6) AS accuracy FROM m")
    op_parts = []
    preds = {}
    for nu_, thr in ((0.2, 0.15), (0.1, 0.1)):
        preds[f"svm|{nu_}"] = f"{_ml_dec(_nu_bound(nu_))} > 0"
        preds[f"ae|{thr}"] = f"ae > {thr!r}"
    for nu_, thr in ((0.2, 0.15), (0.1, 0.1)):
        point = f"nu={nu_}|thr={thr}"
        op_parts.append(f"""SELECT '{point}' AS point, coalesce(s.class, a.class) AS class,
  round(s.acc, 6) AS svm_accuracy, round(a.acc, 6) AS ae_accuracy FROM
  (SELECT family AS class, accuracy AS acc FROM m WHERE candidate = 'svm|{nu_}'
   UNION ALL SELECT 'Benign (Validation)', avg(CASE WHEN {preds[f'svm|{nu_}']} THEN 0.0 ELSE 1.0 END)
   FROM scored WHERE split = 'val') s
  FULL OUTER JOIN
  (SELECT family AS class, accuracy AS acc FROM m WHERE candidate = 'ae|{thr}'
   UNION ALL SELECT 'Benign (Validation)', avg(CASE WHEN {preds[f'ae|{thr}']} THEN 0.0 ELSE 1.0 END)
   FROM scored WHERE split = 'val') a ON s.class = a.class""")
    out["operating_points"] = (base() + ",\n" + counts_cte("c", preds) + ",\n" + metrics_cte("m", "c") + " " +
                               " UNION ALL ".join(op_parts))

    out["fusion_config"] = st + """
SELECT b.w_svm, b.w_ae, round(b.thr, 6) AS thr, b.thr_quantile,
       round(m_svm, 6) AS svm_median, round(d_svm, 6) AS svm_mad,
       round(m_ae, 6) AS ae_median, round(d_ae, 6) AS ae_mad FROM best_fus b, refs"""
    zall = ", ".join(
        f"(coalesce(sp.{f}, med_{i}) - mu_{i}) / (CASE WHEN sd_{i} > 0 THEN sd_{i} ELSE 1.0 END) AS z_{i}"
        for i, f in enumerate(FEATS))
    nk = " + ".join(f"k_{i}" for i in range(len(FEATS)))
    zsq = "(" + " + ".join(f"k_{i} * z_{i} * z_{i}" for i in range(len(FEATS))) + f") / ({nk})"
    zmax = "greatest(" + ", ".join(f"CASE WHEN k_{i} = 1 THEN abs(z_{i}) ELSE 0.0 END" for i in range(len(FEATS))) + ")"
    out["stream_score"] = st + f""",
za AS (SELECT sp.row_id, {zall} FROM sp, stats_m, stats_s),
sa AS (SELECT row_id, {zmax} - (SELECT bnd FROM bound) AS svm, {zsq} AS ae FROM za, keep_t),
fa AS (SELECT row_id, b.w_svm * ((svm - m_svm) / d_svm) + b.w_ae * ((ae - m_ae) / d_ae) AS z, b.thr
       FROM sa, refs, best_fus b)
SELECT row_id, round(z, 6) AS z, CASE WHEN z > thr THEN 1 ELSE 0 END AS pred FROM fa"""
    out["stream_score_bundle"] = out["stream_score"]
    out["csv_flow_scan"] = "WITH " + lineitem_ctes() + """
SELECT report_name, count(*) AS n, CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_price_missing,
       round(sum(price), 2) AS price_total, 7 AS n_features FROM lf GROUP BY report_name"""

    ev_lf = "WITH " + lineitem_ctes() + "," + events_ctes()[len("WITH "):]
    out["flow_union"] = ev_lf + """
SELECT src_file, report_name, count(*) AS n FROM
 (SELECT row_id, src_file, y, report_name FROM lf UNION ALL SELECT row_id, src_file, y, report_name FROM ev)
GROUP BY ALL"""
    out["class_universe"] = ev_lf + """
SELECT report_name AS class FROM lf UNION SELECT report_name FROM ev"""
    out["val_membership"] = sp + """
SELECT report_name, count(*) AS n FROM lf WHERE row_id IN (SELECT row_id FROM sp WHERE split = 'val') GROUP BY ALL"""
    emb_b = _md5_bucket("CAST(vec_id AS VARCHAR)", str(SEED))
    out["recon_error"] = f"""WITH em AS (SELECT CAST(vec_id AS VARCHAR) AS row_id, CASE WHEN label = 0 THEN 0 ELSE 1 END AS y,
    embedding, CASE WHEN label = 0 AND embedding IS NOT NULL THEN CASE WHEN {emb_b} < 7500 THEN 'train' ELSE 'val' END END AS split
  FROM embeddings),
u AS (SELECT row_id, y, split, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM em),
cen AS (SELECT i, avg(CAST(x AS DOUBLE)) AS c FROM u WHERE split = 'train' GROUP BY i)
SELECT row_id, y, round(avg((c - CAST(x AS DOUBLE)) * (c - CAST(x AS DOUBLE))), 6) AS mse
FROM u JOIN cen USING (i) GROUP BY row_id, y"""
    return out | literal_models.oracle_sql(lineitem_ctes())
