"""Registered queries: subgroup fairness audit and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.domain import CATEGORICAL_COLUMNS, PSI_EPS
from cohortlens.operators import drift as DR
from cohortlens.operators import fairness as G
from cohortlens.operators import features as X
from cohortlens.operators import thresholds as T
from cohortlens.plans.registry import register
from cohortlens.plans.sql_helpers import quantile_ctes, union_all
from cohortlens.plans.sql_inputs import AUDIT_DOCS, ENGINEERED, SCORED, STUDENTS, with_ctes
from cohortlens.sources import derived as D

CUT_LI = "TIMESTAMP '1998-07-01 00:00:00'"
CUT_EV = "TIMESTAMP '2024-01-16 00:00:00'"
TARGET = 0.8


# --------------------------------------------------------------------------- fairness SQL

def _audit_sql(src: str, attrs: list[str], pred_sql: str, min_n: int = 10) -> str:
    long = union_all([f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, y, proba AS s, "
                      f"CAST({pred_sql} AS INTEGER) AS p FROM {src}" for a in attrs])
    return f"""
lg AS ({long}),
g AS (SELECT attribute, grp, count(*) AS n, avg(CAST(y AS DOUBLE)) AS prevalence, avg(CAST(p AS DOUBLE)) AS selection_rate,
        CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) AS tp,
        CAST(count(*) FILTER (WHERE y = 0 AND p = 1) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS n_pos, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n_neg
      FROM lg GROUP BY ALL HAVING count(*) >= {min_n}),
ac AS (SELECT attribute, grp, s, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM lg GROUP BY ALL),
aw AS (SELECT *, sum(neg) OVER (PARTITION BY attribute, grp ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum_neg FROM ac),
auc AS (SELECT attribute, grp, CASE WHEN sum(pos) * sum(neg) > 0
          THEN sum(pos * (cum_neg - neg / 2.0)) / (sum(pos) * sum(neg)) END AS roc_auc FROM aw GROUP BY ALL),
audit AS (SELECT g.attribute, g.grp, g.n, prevalence, selection_rate,
            CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END AS tpr, fp / greatest(n_neg, 1.0) AS fpr,
            CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, auc.roc_auc
          FROM g LEFT JOIN auc ON g.attribute = auc.attribute AND g.grp = auc.grp)"""


_AUD_F = ["prevalence", "selection_rate", "tpr", "fpr", "precision", "roc_auc"]
SCORED_ATTRS = ["line_status", "line_no"]
DOC_ATTRS = ["lang", "source"]


@register("subgroup_audit", with_ctes(SCORED).rstrip() + "," + _audit_sql("scored", SCORED_ATTRS, "proba >= 0.5")
          + "\nSELECT * FROM audit", floats=_AUD_F)
def subgroup_audit(spark, sf_dir):
    """Binary subgroup table per (attribute, group), one pass over all attributes."""
    return G.subgroup_metrics(D.scored(spark, sf_dir), "y", "binary", SCORED_ATTRS, score="proba", threshold=0.5)


DOCS_AUDIT = with_ctes(AUDIT_DOCS).rstrip() + "," + _audit_sql("audit_docs", DOC_ATTRS, "proba >= 0.5")


@register("subgroup_audit_docs", DOCS_AUDIT + "\nSELECT * FROM audit", floats=_AUD_F)
def subgroup_audit_docs(spark, sf_dir):
    """G1 + F4 on documents ⋈ labels: groups under 10 rows are dropped."""
    return G.subgroup_metrics(D.audit_docs(spark, sf_dir), "y", "binary", DOC_ATTRS, score="proba", threshold=0.5)


@register("fairness_gaps", DOCS_AUDIT + """
SELECT attribute, max(selection_rate) - min(selection_rate) AS selection_rate_gap, max(tpr) - min(tpr) AS tpr_gap,
  max(fpr) - min(fpr) AS fpr_gap, max(precision) - min(precision) AS precision_gap,
  CASE WHEN max(selection_rate) > 0 THEN min(selection_rate) / max(selection_rate) END AS disparate_impact_ratio,
  CASE WHEN max(selection_rate) > 0 THEN min(selection_rate) / max(selection_rate) < 0.8 END AS four_fifths_flag
FROM audit GROUP BY attribute""",
          floats=["selection_rate_gap", "tpr_gap", "fpr_gap", "precision_gap", "disparate_impact_ratio"])
def fairness_gaps(spark, sf_dir):
    """max−min gaps, disparate-impact ratio and four-fifths flag per attribute."""
    g = G.subgroup_metrics(D.audit_docs(spark, sf_dir), "y", "binary", DOC_ATTRS, score="proba", threshold=0.5,
                           with_auc=False)
    return G.fairness_summary(g, "binary")


@register("recall_gap", DOCS_AUDIT + """
SELECT attribute, max(coalesce(tpr, 0.0)) - min(coalesce(tpr, 0.0)) AS recall_gap FROM audit GROUP BY attribute""",
          floats=["recall_gap"])
def recall_gap(spark, sf_dir):
    """Recall gap from the group rows, null recall counted as 0."""
    g = G.subgroup_metrics(D.audit_docs(spark, sf_dir), "y", "binary", DOC_ATTRS, score="proba", threshold=0.5,
                           with_auc=False)
    return G.recall_gap(g)


@register("fairness_long", DOCS_AUDIT + """
SELECT attribute, grp, metric, value FROM (
  UNPIVOT (SELECT attribute, grp, CAST(n AS DOUBLE) AS n, prevalence, selection_rate, tpr, fpr, precision, roc_auc
           FROM audit)
  ON n, prevalence, selection_rate, tpr, fpr, precision, roc_auc INTO NAME metric VALUE value)
WHERE value IS NOT NULL""", floats=["value"])
def fairness_long(spark, sf_dir):
    """The group table in long form with nulls dropped."""
    g = G.subgroup_metrics(D.audit_docs(spark, sf_dir), "y", "binary", DOC_ATTRS, score="proba", threshold=0.5)
    return G.metrics_long(g)


def _mba_sql() -> str:
    from cohortlens.plans.catalog_metrics import _global_t1_sql, _t5_sql
    body = _t5_sql(with_ctes(SCORED), "scored", "line_no", _global_t1_sql("scored"))
    head = body.split("\nSELECT 'line_no' AS attribute", 1)[0]
    gt = f"({_global_t1_sql('scored')})"
    before = _audit_sql("scored", ["line_no"], f"proba >= {gt}").replace("lg AS", "lgb AS", 1)
    return head + f""",
sc2 AS (SELECT s.*, coalesce(t.threshold, {gt}) AS gthr FROM scored s LEFT JOIN thr t ON s.line_no = t.grp),
b_long AS (SELECT 'line_no' AS attribute, line_no AS grp, y, CAST(proba >= {gt} AS INTEGER) AS p FROM scored),
a_long AS (SELECT 'line_no' AS attribute, line_no AS grp, y, CAST(proba >= gthr AS INTEGER) AS p FROM sc2),
bs AS (SELECT attribute, grp, CASE WHEN sum(y) > 0 THEN CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) / sum(y) ELSE 0.0 END AS tpr,
         avg(CAST(p AS DOUBLE)) AS selection_rate FROM b_long GROUP BY ALL HAVING count(*) >= 10),
as_ AS (SELECT attribute, grp, CASE WHEN sum(y) > 0 THEN CAST(count(*) FILTER (WHERE y = 1 AND p = 1) AS DOUBLE) / sum(y) ELSE 0.0 END AS tpr,
         avg(CAST(p AS DOUBLE)) AS selection_rate FROM a_long GROUP BY ALL HAVING count(*) >= 10)
SELECT bs.attribute, bs.grp, bs.tpr AS tpr_before, bs.selection_rate AS selection_rate_before,
  as_.tpr AS tpr_after, as_.selection_rate AS selection_rate_after
FROM bs JOIN as_ ON bs.attribute = as_.attribute AND bs.grp = as_.grp""".replace("{before}", before)


@register("mitigation_before_after", _mba_sql(),
          floats=["tpr_before", "selection_rate_before", "tpr_after", "selection_rate_after"])
def mitigation_before_after(spark, sf_dir):
    """G7 + J3: recall and selection rate per group under the global threshold vs per-group thresholds."""
    s = D.scored(spark, sf_dir)
    default = T.threshold_at_recall(s, "y", "proba", TARGET).select("threshold").scalar()
    gt = T.group_thresholds(s, "y", "proba", "line_no", TARGET, default)
    mitigated = T.apply_group_thresholds(s, "proba", "line_no", gt, 0.5)
    # unknown groups fall back to the global threshold, as in the audit
    after_pred = F.col("proba") >= F.coalesce(F.col("mitigated.threshold"), default)
    # only recall and selection rate are compared: no grouped AUC needed
    before = G.subgroup_metrics(s, "y", "binary", ["line_no"], score="proba",
                                pred=F.col("proba") >= default, with_auc=False)
    after = G.subgroup_metrics(mitigated, "y", "binary", ["line_no"], score="proba", pred=after_pred,
                               with_auc=False)
    return G.before_after(before, after)


def _sub_sql(kind: str) -> str:
    if kind == "regression":
        parts = [f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, count(*) AS n, "
                 f"avg(abs(y_reg - pred_reg)) AS mae, avg(y_reg - pred_reg) AS mean_residual FROM scored "
                 f"GROUP BY {a} HAVING count(*) >= 10" for a in SCORED_ATTRS]
    else:
        parts = [f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp, count(*) AS n, "
                 f"avg(CAST(y_cls = pred_cls AS DOUBLE)) AS accuracy FROM scored "
                 f"GROUP BY {a} HAVING count(*) >= 10" for a in SCORED_ATTRS]
    return with_ctes(SCORED) + union_all(parts)


@register("subgroup_regression", _sub_sql("regression"), floats=["mae", "mean_residual"])
def subgroup_regression(spark, sf_dir):
    """MAE and mean residual per group."""
    return G.subgroup_metrics(D.scored(spark, sf_dir), "y_reg", "regression", SCORED_ATTRS, pred="pred_reg")


@register("subgroup_multiclass", _sub_sql("multiclass"), floats=["accuracy"])
def subgroup_multiclass(spark, sf_dir):
    """Accuracy per group."""
    return G.subgroup_metrics(D.scored(spark, sf_dir), "y_cls", "multiclass", SCORED_ATTRS, pred="pred_cls")


# --------------------------------------------------------------------------- drift SQL

LI_SPLIT = """
li AS (SELECT l_shipdate, l_returnflag, l_linestatus, l_quantity, l_extendedprice,
         CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 0 ELSE 1 END AS side FROM lineitem)"""
EV_SPLIT = """
ev AS (SELECT event_type, value, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS side FROM events)"""


def _psi_tail_sql(cnt: str, tot: str) -> str:
    e = f"{PSI_EPS!r}::DOUBLE"
    return f"""
SELECT c.feature, c.bin, c.label,
  (c.n_ref / greatest(t.tot_ref, 1.0) + {e}) - {e} AS reference,
  (c.n_cur / greatest(t.tot_cur, 1.0) + {e}) - {e} AS current,
  ((c.n_cur / greatest(t.tot_cur, 1.0) + {e}) - (c.n_ref / greatest(t.tot_ref, 1.0) + {e}))
    * ln((c.n_cur / greatest(t.tot_cur, 1.0) + {e}) / (c.n_ref / greatest(t.tot_ref, 1.0) + {e})) AS contribution
FROM {cnt} c JOIN {tot} t ON c.feature = t.feature"""


def _psi_cat_sql(src: str, feats: list[str]) -> str:
    long = union_all([f"SELECT side, '{f}' AS feature, coalesce(CAST({f} AS VARCHAR), '__null__') AS bin FROM {src}"
                      for f in feats])
    return f"""
pc_long AS ({long}),
pc_cnt AS (SELECT feature, bin, bin AS label, CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS n_ref,
             CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS n_cur FROM pc_long GROUP BY ALL),
pc_tot AS (SELECT feature, CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS tot_ref,
             CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS tot_cur FROM pc_long GROUP BY ALL),
psi_cat AS ({_psi_tail_sql("pc_cnt", "pc_tot")})"""


def _fmt0(x: str) -> str:
    return (f"CASE WHEN {x} = 'inf'::DOUBLE THEN 'inf' WHEN {x} = '-inf'::DOUBLE THEN '-inf' "
            f"ELSE printf('%d', CAST(round_even({x}, 0) AS BIGINT)) END")


def _psi_num_sql(src: str, feats: list[str]) -> str:
    long = union_all([f"SELECT side, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM {src} "
                      f"WHERE {f} IS NOT NULL AND NOT isnan(CAST({f} AS DOUBLE))" for f in feats])
    q = quantile_ctes("pq", "pn_ref", ["feature"], "x", DR.PSI_PROBS)
    return f"""
pn_long AS ({long}),
pn_ref AS (SELECT feature, x FROM pn_long WHERE side = 0),
{q.strip()},
pn_u AS (SELECT feature, list_sort(list_distinct(list(value))) AS u FROM pq GROUP BY feature),
pn_e AS (SELECT feature, list_concat(['-inf'::DOUBLE],
           CASE WHEN len(u) < 2 THEN []::DOUBLE[] ELSE u[2:len(u) - 1] END, ['inf'::DOUBLE]) AS edges FROM pn_u),
pn_b AS (SELECT l.side, l.feature, len(list_filter(e.edges[2:len(e.edges) - 1], lambda q: q <= l.x)) AS bin
         FROM pn_long l JOIN pn_e e ON l.feature = e.feature),
pn_c AS (SELECT feature, bin, CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS n_ref,
           CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS n_cur FROM pn_b GROUP BY ALL),
pn_grid AS (SELECT feature, edges, unnest(range(len(edges) - 1)) AS bin FROM pn_e),
pn_full AS (SELECT g.feature, CAST(g.bin AS VARCHAR) AS bin,
              {_fmt0("g.edges[g.bin + 1]")} || ' to ' || {_fmt0("g.edges[g.bin + 2]")} AS label,
              coalesce(c.n_ref, 0.0) AS n_ref, coalesce(c.n_cur, 0.0) AS n_cur
            FROM pn_grid g LEFT JOIN pn_c c ON g.feature = c.feature AND g.bin = c.bin),
pn_tot AS (SELECT feature, CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS tot_ref,
             CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS tot_cur FROM pn_long GROUP BY ALL),
psi_num AS ({_psi_tail_sql("pn_full", "pn_tot")})"""


_PSI_F = ["reference", "current", "contribution"]
LI_CAT = ["l_returnflag", "l_linestatus"]
LI_NUM = ["l_quantity", "l_extendedprice"]


@register("psi_categorical", with_ctes(LI_SPLIT).rstrip() + "," + _psi_cat_sql("li", LI_CAT).rstrip()
          + "\nSELECT * FROM psi_cat", floats=_PSI_F)
def psi_categorical(spark, sf_dir):
    """Category share table and PSI contributions (early vs late ship dates)."""
    ref, cur = D.lineitem_split(spark, sf_dir)
    return DR.psi_categorical(ref, cur, LI_CAT).select("feature", "bin", "label", *_PSI_F)


@register("psi_numeric", with_ctes(LI_SPLIT).rstrip() + "," + _psi_num_sql("li", LI_NUM).rstrip()
          + "\nSELECT * FROM psi_num", floats=_PSI_F)
def psi_numeric(spark, sf_dir):
    """Reference-quantile bins, labels and PSI contributions."""
    ref, cur = D.lineitem_split(spark, sf_dir)
    return DR.psi_numeric(ref, cur, LI_NUM).select("feature", "bin", "label", *_PSI_F)


def _events_drift_sql() -> str:
    return (with_ctes(EV_SPLIT).rstrip() + "," + _psi_cat_sql("ev", ["event_type"]).rstrip() + ","
            + _psi_num_sql("ev", ["value"]).rstrip() + """
SELECT feature, kind, psi, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT feature, 'categorical' AS kind, sum(contribution) AS psi FROM psi_cat GROUP BY feature
      UNION ALL SELECT feature, 'numeric', sum(contribution) FROM psi_num GROUP BY feature)""")


@register("feature_drift_events", _events_drift_sql(), floats=["psi"])
def feature_drift_events(spark, sf_dir):
    """D3 + X9: PSI and status per feature, kind chosen from the reference type."""
    ref, cur = D.events_split(spark, sf_dir)
    return DR.feature_drift(ref, cur, ["event_type", "value", "not_a_column"])


def _top_sql() -> str:
    return (with_ctes(LI_SPLIT).rstrip() + "," + _psi_cat_sql("li", LI_CAT).rstrip() + ","
            + _psi_num_sql("li", LI_NUM).rstrip() + """,
allp AS (SELECT * FROM psi_cat UNION ALL SELECT * FROM psi_num),
rk AS (SELECT *, current - reference AS shift,
         row_number() OVER (PARTITION BY feature ORDER BY abs(current - reference) DESC, bin) AS rank FROM allp)
SELECT feature, CAST(rank AS INTEGER) AS rank, bin, label, reference, current, shift FROM rk WHERE rank <= 3""")


@register("top_shifts", _top_sql(), floats=["reference", "current", "shift"])
def top_shifts(spark, sf_dir):
    """The three bins per feature with the largest share shift."""
    ref, cur = D.lineitem_split(spark, sf_dir)
    return DR.top_shifts(DR.share_tables(ref, cur, LI_CAT + LI_NUM))


def _ks_sql(src: str, col: str) -> str:
    return f"""
ku AS (SELECT CAST({col} AS DOUBLE) AS v, CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END AS a,
         CASE WHEN side = 1 THEN 1.0 ELSE 0.0 END AS b FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
kc AS (SELECT v, sum(a) AS a, sum(b) AS b FROM ku GROUP BY v),
kw AS (SELECT v, sum(a) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS ca,
         sum(b) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS cb FROM kc),
kt AS (SELECT sum(a) AS n1, sum(b) AS n2, sum(a * v) AS s1, sum(b * v) AS s2 FROM ku),
ks AS (SELECT max(abs(ca / n1 - cb / n2)) AS ks_statistic, CAST(max(n1) AS BIGINT) AS n_reference,
         CAST(max(n2) AS BIGINT) AS n_current, max(s1) / max(n1) AS reference_mean, max(s2) / max(n2) AS current_mean
       FROM kw, kt)"""


_KS_F = ["ks_statistic", "reference_mean", "current_mean"]


@register("ks_statistic", with_ctes(EV_SPLIT).rstrip() + "," + _ks_sql("ev", "value").rstrip()
          + "\nSELECT * FROM ks", floats=_KS_F)
def ks_statistic(spark, sf_dir):
    """Two-sample KS statistic of event values, early vs late January."""
    ref, cur = D.events_split(spark, sf_dir)
    return DR.ks_statistic(ref, cur, "value")


SC_SPLIT = """
scs AS (SELECT proba AS score, CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 0 ELSE 1 END AS side
        FROM scored)"""


@register("score_drift", with_ctes(SCORED, SC_SPLIT).rstrip() + "," + _psi_num_sql("scs", ["score"]).rstrip()
          + "," + _ks_sql("scs", "score").rstrip() + """
SELECT p.psi, CASE WHEN p.psi >= 0.25 THEN 'alert' WHEN p.psi >= 0.1 THEN 'warn' ELSE 'ok' END AS status, ks.*
FROM (SELECT sum(contribution) AS psi FROM psi_num) p, ks""", floats=["psi", *_KS_F])
def score_drift(spark, sf_dir):
    """Output drift of the probability: PSI + status + KS + means (p-value left out of the check)."""
    s = D.scored(spark, sf_dir)
    cut = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    r = DR.score_drift(s.where(F.col("l_shipdate") < cut), s.where(F.col("l_shipdate") >= cut), "proba")
    return r.drop("ks_pvalue")


FORCED = """
forced AS (SELECT *, 0 AS side FROM eng UNION ALL SELECT *, 1 AS side FROM eng WHERE lunch = 'free/reduced')"""


def _forced_sql(final: str) -> str:
    return (with_ctes(STUDENTS, ENGINEERED, FORCED).rstrip() + ","
            + _psi_cat_sql("forced", list(CATEGORICAL_COLUMNS)).rstrip() + "," + f"""
feats AS (SELECT feature, 'categorical' AS kind, sum(contribution) AS psi,
            CASE WHEN sum(contribution) >= 0.25 THEN 'alert' WHEN sum(contribution) >= 0.1 THEN 'warn' ELSE 'ok' END AS status
          FROM psi_cat GROUP BY feature)
{final}""")


def _forced_inputs(spark, sf_dir):
    eng = X.engineer(D.students(spark, sf_dir))
    return eng, eng.where(F.col("lunch") == "free/reduced")


@register("drift_features_forced", _forced_sql("SELECT * FROM feats"), floats=["psi"])
def drift_features_forced(spark, sf_dir):
    """D3/D7 on a forced shift: current = free/reduced lunch only → lunch alerts, others stay ok."""
    ref, cur = _forced_inputs(spark, sf_dir)
    return DR.drift_report(ref, cur, list(CATEGORICAL_COLUMNS))["features"]


@register("drift_report", _forced_sql("""
SELECT CASE WHEN (SELECT count(*) FROM forced WHERE side = 1) < 20 THEN 'insufficient'
            WHEN max(CASE status WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) = 2 THEN 'alert'
            WHEN max(CASE status WHEN 'alert' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) = 1 THEN 'warn' ELSE 'ok' END AS status,
  (SELECT count(*) FROM forced WHERE side = 0) AS n_reference, (SELECT count(*) FROM forced WHERE side = 1) AS n_current,
  20 AS min_rows, 0.1::DOUBLE AS warn, 0.25::DOUBLE AS alert
FROM feats"""), floats=["warn", "alert"])
def drift_report(spark, sf_dir):
    """D7 + X10: report header with the overall status roll-up (computed_at left out of the check)."""
    ref, cur = _forced_inputs(spark, sf_dir)
    return DR.drift_report(ref, cur, list(CATEGORICAL_COLUMNS))["header"].drop("computed_at")


@register("drift_display", (with_ctes(LI_SPLIT, SCORED, SC_SPLIT).rstrip() + ","
                            + _psi_cat_sql("li", LI_CAT).rstrip() + "," + _psi_num_sql("li", LI_NUM).rstrip() + ","
                            + _psi_num_sql("scs", ["score"]).replace("pn_", "sn_").replace("pq", "sq")
                            .replace("psi_num", "psi_score").rstrip() + """,
allp AS (SELECT * FROM psi_cat UNION ALL SELECT * FROM psi_num),
feats AS (SELECT feature, sum(contribution) AS psi FROM allp GROUP BY feature),
rk AS (SELECT feature, label, current - reference AS shift,
         row_number() OVER (PARTITION BY feature ORDER BY abs(current - reference) DESC, bin) AS rn FROM allp),
sp AS (SELECT sum(contribution) AS psi FROM psi_score)
SELECT f.feature, f.psi, CASE WHEN f.psi >= 0.25 THEN 'alert' WHEN f.psi >= 0.1 THEN 'warn' ELSE 'ok' END AS status,
  rk.label AS largest_shift_bin, rk.shift AS largest_shift
FROM feats f LEFT JOIN rk ON f.feature = rk.feature AND rk.rn = 1
UNION ALL SELECT '(model output)', psi, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'ok' END,
  CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM sp"""), floats=["psi", "largest_shift"])
def drift_display(spark, sf_dir):
    """Feature rows + "(model output)" row, each with its largest shift."""
    ref, cur = D.lineitem_split(spark, sf_dir)
    s = D.scored(spark, sf_dir)
    cut = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    rs = s.where(F.col("l_shipdate") < cut).select(F.col("proba").alias("score"))
    cs = s.where(F.col("l_shipdate") >= cut).select(F.col("proba").alias("score"))
    rep = DR.drift_report(ref, cur, LI_CAT + LI_NUM, reference_scores=rs, current_scores=cs)
    return DR.drift_display(rep)
