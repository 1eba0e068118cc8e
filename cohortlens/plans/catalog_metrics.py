"""Registered queries: evaluation metrics, thresholds, conformal intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import conformal as Q
from cohortlens.operators import metrics as M
from cohortlens.operators import profiling as A
from cohortlens.operators import thresholds as T
from cohortlens.plans.registry import register
from cohortlens.plans.sql_helpers import union_all
from cohortlens.plans.sql_inputs import AUDIT_DOCS, SCORED, with_ctes
from cohortlens.sources import derived as D

SC = with_ctes(SCORED)
CUT = "TIMESTAMP '1998-07-01 00:00:00'"
ALPHA = 0.1
TARGET = 0.8


def _scored(spark, sf_dir):
    return D.scored(spark, sf_dir)


def _split(spark, sf_dir):
    s = _scored(spark, sf_dir)
    cut = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    return s.where(F.col("l_shipdate") < cut), s.where(F.col("l_shipdate") >= cut)


# --------------------------------------------------------------------------- regression

def _reg_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    ks = f"{k}, " if keys else ""
    gb = f" GROUP BY {k}" if keys else ""
    return SC + f"""
SELECT {ks}n, CASE WHEN sst > 0 THEN 1.0 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END AS r2,
  sqrt(sse / n) AS rmse, mae, mape, residual_std
FROM (SELECT {ks}count(*) AS n, sum((y_reg - pred_reg) * (y_reg - pred_reg)) AS sse,
        var_pop(y_reg) * count(*) AS sst, avg(abs(y_reg - pred_reg)) AS mae,
        avg(abs(y_reg - pred_reg) / greatest(y_reg, 1.0)) * 100.0 AS mape,
        stddev_pop(y_reg - pred_reg) AS residual_std
      FROM scored{gb}) t"""


_REG_F = ["r2", "rmse", "mae", "mape", "residual_std"]


@register("regression_metrics", _reg_sql([]), floats=_REG_F)
def regression_metrics(spark, sf_dir):
    """M1: r2, rmse, mae, mape, residual std of the regression scores."""
    return M.regression_metrics(_scored(spark, sf_dir), "y_reg", "pred_reg")


@register("regression_metrics_by_status", _reg_sql(["line_status"]), floats=_REG_F)
def regression_metrics_by_status(spark, sf_dir):
    """M1 per group (line status)."""
    return M.regression_metrics(_scored(spark, sf_dir), "y_reg", "pred_reg", ["line_status"])


# --------------------------------------------------------------------------- ranking metrics

def _auc_sql(score: str, keys: list[str], label: str | None) -> str:
    k = ", ".join(keys)
    ks = f"{k}, " if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    gb = f" GROUP BY {k}" if keys else ""
    name = f"'{label}' AS score_name, " if label else ""
    return f"""SELECT {name}{ks}sum(pos * (cum_neg - neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT *, sum(neg) OVER ({part}ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum_neg
      FROM (SELECT {ks}{score} AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM scored WHERE {score} IS NOT NULL GROUP BY ALL) c) w{gb}"""


@register("roc_auc", SC + union_all([_auc_sql("proba", [], "proba"), _auc_sql("proba_tied", [], "proba_tied")]),
          floats=["roc_auc"])
def roc_auc(spark, sf_dir):
    """M3: ROC-AUC of a nearly tie-free and of a heavily tied score."""
    s = _scored(spark, sf_dir)
    return (M.roc_auc(s, "y", "proba").withColumn("score_name", F.lit("proba"))
            .unionByName(M.roc_auc(s, "y", "proba_tied").withColumn("score_name", F.lit("proba_tied"))))


@register("roc_auc_by_group", SC + _auc_sql("proba", ["line_no"], None), floats=["roc_auc"])
def roc_auc_by_group(spark, sf_dir):
    """M3/G4 per group: prefix sums partitioned by (group, value range)."""
    return M.roc_auc(_scored(spark, sf_dir), "y", "proba", ["line_no"])


def _ap_sql(score: str) -> str:
    return f"""SELECT '{score}' AS score_name, sum(pos * tp / (tp + fp)) / max(P) AS average_precision
FROM (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
        sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS P
      FROM (SELECT {score} AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM scored WHERE {score} IS NOT NULL GROUP BY 1) c) w"""


@register("avg_precision", SC + union_all([_ap_sql("proba"), _ap_sql("proba_tied")]),
          floats=["average_precision"])
def avg_precision(spark, sf_dir):
    """M4: step-wise average precision."""
    s = _scored(spark, sf_dir)
    return (M.average_precision(s, "y", "proba").withColumn("score_name", F.lit("proba"))
            .unionByName(M.average_precision(s, "y", "proba_tied").withColumn("score_name", F.lit("proba_tied"))))


_EPS = M.EPS


def _binary_sql(thr: float) -> str:
    p1 = f"least(greatest(proba, {_EPS!r}::DOUBLE), {1.0 - _EPS!r}::DOUBLE)"
    return SC.rstrip() + f""",
auc AS ({_auc_sql("proba", [], None)}),
ap AS ({_ap_sql("proba")}),
cc AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND proba >= {thr}) AS DOUBLE) AS tp,
              CAST(count(*) FILTER (WHERE y = 0 AND proba >= {thr}) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (WHERE y = 0 AND proba < {thr}) AS DOUBLE) AS tn,
              CAST(count(*) FILTER (WHERE y = 1 AND proba < {thr}) AS DOUBLE) AS fn FROM scored),
cm AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy,
         (tp / (tp + fn) + tn / (tn + fp)) / 2.0 AS balanced_accuracy,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
         CASE WHEN (tp + fn) + (tp + fp) > 0 THEN 2.0 * tp / (1.0 * (tp + fn) + (tp + fp)) ELSE 0.0 END AS f1
       FROM cc),
base AS (SELECT CAST(count(*) AS DOUBLE) AS n_test, avg((proba - y) * (proba - y)) AS brier,
           avg(-CASE WHEN y = 1 THEN ln({p1}) ELSE ln(1.0 - {p1}) END) AS log_loss,
           avg(CAST(y AS DOUBLE)) AS positive_rate,
           avg(CAST(proba >= {thr} AS DOUBLE)) AS flagged_rate FROM scored),
wide AS (SELECT base.*, accuracy, balanced_accuracy, precision, recall, f1,
           5.0 * precision * recall / greatest(4.0 * precision + recall, 1e-12) AS f2,
           auc.roc_auc, ap.average_precision, {thr}::DOUBLE AS threshold
         FROM base, cm, auc, ap)
UNPIVOT wide ON COLUMNS(*) INTO NAME metric VALUE value"""


@register("binary_metrics", _binary_sql(0.5), floats=["value"])
def binary_metrics(spark, sf_dir):
    """The binary metric bundle at threshold 0.5, long form."""
    return M.long_metrics(M.binary_metrics(_scored(spark, sf_dir), "y", "proba", 0.5))


# --------------------------------------------------------------------------- multiclass

_CLS_SQL = """
cells AS (SELECT y_cls AS yt, pred_cls AS yp, count(*) AS c FROM scored GROUP BY ALL),
roles AS (SELECT yt AS cls, c AS support, 0 AS predicted, CASE WHEN yt = yp THEN c ELSE 0 END AS tp FROM cells
          UNION ALL SELECT yp, 0, c, 0 FROM cells),
per AS (SELECT cls, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(support) AS BIGINT) AS support,
          CAST(sum(predicted) AS DOUBLE) AS predicted FROM roles GROUP BY cls)"""


@register("class_report", SC.rstrip() + "," + _CLS_SQL + """,
pr AS (SELECT CAST(cls AS VARCHAR) AS label,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END AS f1,
         support, tp FROM per)
SELECT label, precision, recall, f1, support FROM pr
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
  CAST(sum(support) AS BIGINT) FROM pr
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pr
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pr""",
          floats=["precision", "recall", "f1"])
def class_report(spark, sf_dir):
    """Classification report of a 3-class prediction."""
    return M.class_report(_scored(spark, sf_dir), "y_cls", "pred_cls")


@register("confusion", SC + """
SELECT a.l AS y_true, b.l AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT l FROM (SELECT y_cls AS l FROM scored UNION SELECT pred_cls FROM scored)) a
CROSS JOIN (SELECT DISTINCT l FROM (SELECT y_cls AS l FROM scored UNION SELECT pred_cls FROM scored)) b
LEFT JOIN (SELECT y_cls, pred_cls, count(*) AS n FROM scored GROUP BY ALL) c
  ON c.y_cls = a.l AND c.pred_cls = b.l""")
def confusion(spark, sf_dir):
    """Dense confusion matrix (zero cells kept)."""
    return M.confusion_matrix(_scored(spark, sf_dir), "y_cls", "pred_cls")


def _mc_sql() -> str:
    eps = _EPS
    probs = ["prob_a", "prob_n", "prob_r"]
    ovr = union_all([f"SELECT {i} AS cls, CASE WHEN y_cls = {i} THEN 1 ELSE 0 END AS y, {p} AS s FROM scored"
                     for i, p in enumerate(probs)])
    return SC.rstrip() + f""",
pred AS (SELECT *, CASE WHEN prob_a = greatest(prob_a, prob_n, prob_r) THEN 0
                        WHEN prob_n = greatest(prob_a, prob_n, prob_r) THEN 1 ELSE 2 END AS yp FROM scored),
cells AS (SELECT y_cls AS yt, yp, count(*) AS c FROM pred GROUP BY ALL),
roles AS (SELECT yt AS cls, c AS support, 0 AS predicted, CASE WHEN yt = yp THEN c ELSE 0 END AS tp FROM cells
          UNION ALL SELECT yp, 0, c, 0 FROM cells),
per AS (SELECT cls, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(support) AS DOUBLE) AS support,
          CAST(sum(predicted) AS DOUBLE) AS predicted FROM roles GROUP BY cls),
cls AS (SELECT sum(tp) / sum(support) AS accuracy,
          avg(CASE WHEN support > 0 THEN tp / support END) AS balanced_accuracy,
          avg(CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END) AS f1_macro,
          sum(CASE WHEN predicted + support > 0 THEN 2.0 * tp / (predicted + support) ELSE 0.0 END * support)
            / sum(support) AS f1_weighted FROM per),
ovr AS ({ovr}),
oc AS (SELECT cls, s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM ovr GROUP BY ALL),
ow AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum_neg FROM oc),
auc AS (SELECT avg(a) AS roc_auc_ovr FROM (SELECT cls, sum(pos * (cum_neg - neg / 2.0)) / (sum(pos) * sum(neg)) AS a
        FROM ow GROUP BY cls)),
ll AS (SELECT avg(-ln(least(greatest([prob_a, prob_n, prob_r][y_cls + 1], {eps!r}::DOUBLE), {1 - eps!r}::DOUBLE)))
         AS log_loss FROM scored)
SELECT * FROM cls, auc, ll"""


@register("multiclass_metrics", _mc_sql(),
          floats=["accuracy", "balanced_accuracy", "f1_macro", "f1_weighted", "roc_auc_ovr", "log_loss"])
def multiclass_metrics(spark, sf_dir):
    """Multiclass bundle from class probabilities (argmax prediction)."""
    return M.multiclass_metrics(_scored(spark, sf_dir), "y_cls", ["prob_a", "prob_n", "prob_r"])


# --------------------------------------------------------------------------- curves

@register("roc_points", SC + """
SELECT s AS threshold, fp / N AS fpr, tp / P AS tpr
FROM (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
        sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
        sum(pos) OVER () AS P, sum(neg) OVER () AS N
      FROM (SELECT proba AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM scored GROUP BY 1) c) w
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""", floats=["threshold", "fpr", "tpr"])
def roc_points(spark, sf_dir):
    """Every ROC point."""
    return M.roc_points(_scored(spark, sf_dir), "y", "proba")


@register("pr_points", SC + """
SELECT s AS threshold, CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS recall,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision
FROM (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
        sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS P
      FROM (SELECT proba AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM scored GROUP BY 1) c) w
UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0, 1.0""", floats=["threshold", "recall", "precision"])
def pr_points(spark, sf_dir):
    """Every precision-recall point plus the final (0, 1)."""
    return M.pr_points(_scored(spark, sf_dir), "y", "proba")


def _calib_sql() -> str:
    from cohortlens.plans.sql_helpers import quantile_ctes
    probs = [i * 100.0 / 10 / 100.0 for i in range(11)]
    q = quantile_ctes("qq", "src", [], "value", probs)
    return SC.rstrip() + f""",
src AS (SELECT proba AS value FROM scored WHERE proba IS NOT NULL),
{q.strip()},
inner_e AS (SELECT value AS e FROM qq WHERE prob > 0 AND prob < 1)
SELECT CAST((SELECT count(*) FROM inner_e WHERE e < s.proba) AS INTEGER) AS bin, count(*) AS n,
  avg(proba) AS prob_pred, avg(CAST(y AS DOUBLE)) AS prob_true
FROM scored s GROUP BY 1"""


@register("calibration", _calib_sql(), floats=["prob_pred", "prob_true"])
def calibration(spark, sf_dir):
    """Reliability curve over 10 quantile bins."""
    return M.calibration_curve(_scored(spark, sf_dir), "y", "proba", 10)


def _sweep_sql() -> str:
    grid = M.sweep_grid()
    vals = ", ".join(f"({t!r}::DOUBLE)" for t in grid)
    return SC + f"""
SELECT g.t AS threshold,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall,
  CASE WHEN P + (tp + fp) > 0 THEN 2.0 * tp / (1.0 * P + (tp + fp)) ELSE 0.0 END AS f1
FROM (SELECT g.t, CAST(count(*) FILTER (WHERE s.y = 1 AND s.proba >= g.t) AS DOUBLE) AS tp,
        CAST(count(*) FILTER (WHERE s.y = 0 AND s.proba >= g.t) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE s.y = 1) AS DOUBLE) AS P
      FROM (VALUES {vals}) g(t) CROSS JOIN scored s GROUP BY g.t) g"""


@register("threshold_sweep", _sweep_sql(), floats=["threshold", "precision", "recall", "f1"])
def threshold_sweep(spark, sf_dir):
    """Precision, recall, F1 on the 91-point grid 0.05 … 0.95."""
    return M.threshold_sweep(_scored(spark, sf_dir), "y", "proba")


@register("residual_histogram", SC.rstrip() + """,
d AS (SELECT y_reg - pred_reg AS x FROM scored),
lim AS (SELECT CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
               CASE WHEN max(x) = min(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM d),
c AS (SELECT CAST(least(greatest(floor((x - lo) * (25.0 / (hi - lo))), 0), 24) AS INTEGER) AS bin, count(*) AS n
      FROM d, lim GROUP BY ALL)
SELECT CAST(r.range AS INTEGER) AS bin, lo + CAST(r.range AS INTEGER) * ((hi - lo) / 25.0) AS bin_lo,
  lo + (CAST(r.range AS INTEGER) + 1) * ((hi - lo) / 25.0) AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(25) r CROSS JOIN lim LEFT JOIN c ON c.bin = r.range""", floats=["bin_lo", "bin_hi"])
def residual_histogram(spark, sf_dir):
    """Residual distribution (25 equal-width bins)."""
    s = _scored(spark, sf_dir).select((F.col("y_reg") - F.col("pred_reg")).alias("residual"))
    return A.histogram(s, "residual", 25)


# --------------------------------------------------------------------------- thresholds

def _grid_sql(src: str, keys: list[str]) -> str:
    """CTEs ``gpts`` (keys, g, tp, fp, P, N) counting raw score >= g by ordering probes after ties."""
    k = ", ".join(keys)
    ks = f"{k}, " if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    return f"""
grid AS (SELECT DISTINCT {ks}round_even(proba * 10000.0, 0) / 10000.0 AS g FROM {src} WHERE proba IS NOT NULL),
u AS (SELECT {ks}proba AS v, 0 AS probe, y FROM {src} WHERE proba IS NOT NULL
      UNION ALL SELECT {ks}g, 1, 0 FROM grid),
run AS (SELECT {ks}v, probe,
          sum(CASE WHEN probe = 0 THEN y ELSE 0 END) OVER ({part}ORDER BY v DESC, probe ASC ROWS UNBOUNDED PRECEDING) AS tp,
          sum(CASE WHEN probe = 0 THEN 1 - y ELSE 0 END) OVER ({part}ORDER BY v DESC, probe ASC ROWS UNBOUNDED PRECEDING) AS fp,
          sum(CASE WHEN probe = 0 THEN y ELSE 0 END) OVER ({part.strip()}) AS P
        FROM u),
gpts AS (SELECT {ks}v AS g, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(P AS DOUBLE) AS P
         FROM run WHERE probe = 1)"""


def _stats_sql(src: str, thr_cte: str, keys: list[str], beta: float = 2.0) -> str:
    k = ", ".join(keys)
    ks = f"{k}, " if keys else ""
    on = " AND ".join(f"s.{c} = t.{c}" for c in keys) or "TRUE"
    b2 = beta * beta
    sk = ", ".join(f"s.{c}" for c in keys)
    return f"""
st AS (SELECT {sk + ', ' if keys else ''}max(t.threshold) AS threshold,
         CAST(count(*) FILTER (WHERE s.y = 1 AND s.proba >= t.threshold) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE s.y = 0 AND s.proba >= t.threshold) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE s.y = 1 AND s.proba < t.threshold) AS DOUBLE) AS fn,
         avg(CAST(s.proba >= t.threshold AS DOUBLE)) AS flagged_rate
       FROM {src} s JOIN {thr_cte} t ON {on} GROUP BY ALL),
stats AS (SELECT {ks}threshold,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
            CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
            flagged_rate,
            CASE WHEN {b2!r} * (tp + fn) + (tp + fp) > 0
                 THEN {1 + b2!r} * tp / ({b2!r} * (tp + fn) + (tp + fp)) ELSE 0.0 END AS fbeta
          FROM st)"""


def _t1_sql() -> str:
    return SC.rstrip() + "," + _grid_sql("scored", []) + f""",
thr AS (SELECT coalesce(max(g) FILTER (WHERE CASE WHEN P > 0 THEN tp / P ELSE 0.0 END >= {TARGET}), 0.5)
          AS threshold FROM gpts),""" + _stats_sql("scored", "thr", []) + """
SELECT 'target_recall' AS strategy, * FROM stats"""


_ST_F = ["threshold", "recall", "precision", "flagged_rate", "fbeta"]


@register("threshold_at_recall", _t1_sql(), floats=_ST_F)
def threshold_at_recall(spark, sf_dir):
    """T1 + T3: highest rounded-grid threshold with recall >= 0.8, with its statistics."""
    return T.optimise_threshold(_scored(spark, sf_dir), "y", "proba", "target_recall", TARGET)


def _t2_sql() -> str:
    return SC.rstrip() + "," + _grid_sql("scored", []) + """,
fb AS (SELECT g, 5.0 * tp / (4.0 * P + (tp + fp)) AS f FROM gpts),
thr AS (SELECT min(g) AS threshold FROM fb WHERE f = (SELECT max(f) FROM fb)),""" + _stats_sql(
        "scored", "thr", []) + """
SELECT 'fbeta' AS strategy, * FROM stats"""


@register("threshold_fbeta", _t2_sql(), floats=_ST_F)
def threshold_fbeta(spark, sf_dir):
    """T2 + T3: F2-maximising grid threshold (lowest wins ties), with its statistics."""
    return T.optimise_threshold(_scored(spark, sf_dir), "y", "proba", "fbeta", beta=2.0)


def _t5_sql(src_ctes: str, src: str, group: str, default_sql: str) -> str:
    g = f"""
gsrc AS (SELECT CAST({group} AS VARCHAR) AS grp, y, proba FROM {src}),"""
    return src_ctes.rstrip() + "," + g + _grid_sql("gsrc", ["grp"]) + f""",
fitted AS (SELECT grp, coalesce(max(g) FILTER (WHERE CASE WHEN P > 0 THEN tp / P ELSE 0.0 END >= {TARGET}), min(g))
             AS t FROM gpts GROUP BY grp),
sizes AS (SELECT grp, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive FROM gsrc GROUP BY grp),
thr AS (SELECT s.grp, s.n, s.n_positive,
          CASE WHEN s.n_positive >= 10 THEN f.t ELSE ({default_sql}) END AS threshold
        FROM sizes s LEFT JOIN fitted f ON s.grp = f.grp),""" + _stats_sql("gsrc", "thr", ["grp"]) + f"""
SELECT '{group}' AS attribute, t.grp, t.n, t.n_positive, t.threshold, st.recall, st.precision, st.flagged_rate
FROM thr t JOIN stats st ON t.grp = st.grp"""


def _global_t1_sql(src: str) -> str:
    """Scalar SQL for the global T1 threshold of ``src``."""
    return f"""SELECT coalesce(max(g2) FILTER (WHERE tp2 / P2 >= {TARGET}), 0.5) FROM (
  SELECT v AS g2, CAST(tp AS DOUBLE) AS tp2, CAST(P AS DOUBLE) AS P2 FROM (
    SELECT v, probe, sum(CASE WHEN probe = 0 THEN y ELSE 0 END) OVER (ORDER BY v DESC, probe ASC ROWS UNBOUNDED PRECEDING) AS tp,
      sum(CASE WHEN probe = 0 THEN y ELSE 0 END) OVER () AS P
    FROM (SELECT proba AS v, 0 AS probe, y FROM {src}
          UNION ALL SELECT DISTINCT round_even(proba * 10000.0, 0) / 10000.0, 1, 0 FROM {src})) r WHERE probe = 1) z"""


_GT_F = ["threshold", "recall", "precision", "flagged_rate"]


@register("group_thresholds", _t5_sql(SC, "scored", "line_no", _global_t1_sql("scored")), floats=_GT_F)
def group_thresholds(spark, sf_dir):
    """T4 + T5: per-group thresholds at recall 0.8 (default = the global threshold)."""
    s = _scored(spark, sf_dir)
    default = T.threshold_at_recall(s, "y", "proba", TARGET).select("threshold").scalar()
    return T.group_thresholds(s, "y", "proba", "line_no", TARGET, default)


@register("group_thresholds_docs", _t5_sql(with_ctes(AUDIT_DOCS), "audit_docs", "source", "0.42"),
          floats=_GT_F)
def group_thresholds_docs(spark, sf_dir):
    """T5 on documents ⋈ labels by source: small groups keep the default 0.42."""
    return T.group_thresholds(D.audit_docs(spark, sf_dir), "y", "proba", "source", TARGET, 0.42)


def _mitigation_sql() -> str:
    body = _t5_sql(SC, "scored", "line_no", _global_t1_sql("scored"))
    head, tail = body.split("\nSELECT 'line_no' AS attribute", 1)
    return head + f""",
gt AS ({_global_t1_sql("scored")}),
flags AS (SELECT s.y, CAST(s.proba >= (SELECT * FROM gt) AS INTEGER) AS before_flag,
            CAST(s.proba >= coalesce(t.threshold, (SELECT * FROM gt)) AS INTEGER) AS after_flag
          FROM scored s LEFT JOIN thr t ON CAST(s.line_no AS VARCHAR) = t.grp),
lng AS (SELECT 'before' AS phase, y, before_flag AS p FROM flags UNION ALL SELECT 'after', y, after_flag FROM flags)
SELECT phase,
  CASE WHEN sum(y) > 0 THEN CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) / sum(y) ELSE 0.0 END AS recall,
  CASE WHEN sum(p) > 0 THEN CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) / sum(p) ELSE 0.0 END AS precision,
  avg(CAST(p AS DOUBLE)) AS flagged_rate,
  CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS DOUBLE) / greatest(CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE), 1.0) AS fpr
FROM lng GROUP BY phase"""


@register("mitigation_overall", _mitigation_sql(), floats=["recall", "precision", "flagged_rate", "fpr"])
def mitigation_overall(spark, sf_dir):
    """T6 + X13 + X14: overall recall / precision / flagged / FPR before and after group thresholds."""
    s = _scored(spark, sf_dir)
    default = T.threshold_at_recall(s, "y", "proba", TARGET).select("threshold").scalar()
    gt = T.group_thresholds(s, "y", "proba", "line_no", TARGET, default)
    scored = T.apply_group_thresholds(s.withColumn("before", F.col("proba") >= default),
                                      "proba", "line_no", gt, 0.5)
    scored = scored.withColumn("after", F.col("mitigated.at_risk"))
    long = scored.select("y", F.explode(F.array(
        F.struct(F.lit("before").alias("phase"), F.col("before").cast("int").alias("p")),
        F.struct(F.lit("after").alias("phase"), F.col("after").cast("int").alias("p")))).alias("x")
    ).select("y", "x.phase", "x.p")
    return T.overall_metrics(long, "y", "p", ["phase"])


# --------------------------------------------------------------------------- conformal

def _conf_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    ks = f"{k}, " if keys else ""
    part = f"PARTITION BY {k} " if keys else ""
    return SC + f"""
SELECT {ks}n, k, v AS quantile FROM (
  SELECT {ks}v, row_number() OVER ({part}ORDER BY v) AS rn, count(*) OVER ({part.strip()}) AS n,
    CAST(ceil(CAST(count(*) OVER ({part.strip()}) + 1 AS DOUBLE) * {1.0 - ALPHA!r}) AS BIGINT) AS k
  FROM (SELECT {ks}abs(y_reg - pred_reg) AS v FROM scored) a) r
WHERE rn = least(k, n)"""


@register("conformal_halfwidth", _conf_sql([]), floats=["quantile"])
def conformal_halfwidth(spark, sf_dir):
    """Finite-sample conformal quantile of |residual| at alpha 0.1."""
    s = _scored(spark, sf_dir).select((F.col("y_reg") - F.col("pred_reg")).alias("r"))
    return Q.conformal_quantile(s, "r", ALPHA)


@register("conformal_by_group", _conf_sql(["line_status"]), floats=["quantile"])
def conformal_by_group(spark, sf_dir):
    """Q1 per group (line status)."""
    s = _scored(spark, sf_dir).select("line_status", (F.col("y_reg") - F.col("pred_reg")).alias("r"))
    return Q.conformal_quantile(s, "r", ALPHA, ["line_status"])


def _cov_sql() -> str:
    q = f"""(SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n,
        CAST(ceil(CAST(count(*) OVER () + 1 AS DOUBLE) * {1.0 - ALPHA!r}) AS BIGINT) AS k
      FROM (SELECT abs(y_reg - pred_reg) AS v FROM scored WHERE l_shipdate < {CUT})) WHERE rn = least(k, n))"""
    return SC.rstrip() + f""",
ev AS (SELECT y_reg, pred_reg, greatest(pred_reg - {q}, 0.0) AS lower, pred_reg + {q} AS upper
       FROM scored WHERE l_shipdate >= {CUT})
SELECT avg(CAST(y_reg >= lower AND y_reg <= upper AS DOUBLE)) AS coverage, {1.0 - ALPHA!r}::DOUBLE AS nominal_coverage,
  avg(upper - lower) AS mean_width FROM ev"""


@register("interval_coverage", _cov_sql(), floats=["coverage", "nominal_coverage", "mean_width"])
def interval_coverage(spark, sf_dir):
    """Q1 + X12 + M2: calibrate on early ship dates, check coverage on later ones."""
    cal, ev = _split(spark, sf_dir)
    q = Q.conformal_quantile(cal.select((F.col("y_reg") - F.col("pred_reg")).alias("r")), "r", ALPHA)
    return M.interval_coverage(ev, "y_reg", "pred_reg", q.select("quantile").scalar(), ALPHA, 0.0, None)


@register("interval_rows", SC.rstrip() + f""",
qv AS (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n,
        CAST(ceil(CAST(count(*) OVER () + 1 AS DOUBLE) * {1.0 - ALPHA!r}) AS BIGINT) AS k
      FROM (SELECT abs(y_reg - pred_reg) AS v FROM scored WHERE l_shipdate < {CUT})) WHERE rn = least(k, n))
SELECT y_reg, pred_reg, greatest(pred_reg - (SELECT v FROM qv), 0.0) AS lower, pred_reg + (SELECT v FROM qv) AS upper,
  CAST(y_reg >= greatest(pred_reg - (SELECT v FROM qv), 0.0) AND y_reg <= pred_reg + (SELECT v FROM qv) AS INTEGER) AS covered
FROM scored WHERE l_shipdate >= {CUT}""", floats=["y_reg", "pred_reg", "lower", "upper"])
def interval_rows(spark, sf_dir):
    """Every evaluation row with its interval and covered flag."""
    cal, ev = _split(spark, sf_dir)
    q = Q.conformal_quantile(cal.select((F.col("y_reg") - F.col("pred_reg")).alias("r")), "r", ALPHA)
    return M.interval_rows(ev.select("y_reg", "pred_reg"), "y_reg", "pred_reg",
                           q.select("quantile").scalar(), 0.0, None)
