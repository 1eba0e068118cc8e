"""Subgroup fairness audit.

All attributes are audited in one pass: ``unpivot`` the attributes into
``(attribute, grp)`` and aggregate once; grouped ROC-AUC uses the same keys
with range-partitioned prefix sums, so a group holding a third of the rows is
split across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import expr as E
from cohortlens.functions.domain import MIN_GROUP_SIZE
from cohortlens.operators.metrics import roc_auc
from cohortlens.operators.profiling import long_attributes

BINARY_GAPS = ("selection_rate", "tpr", "fpr", "precision")
GAP_METRICS = {"binary": BINARY_GAPS, "regression": ("mae",), "multiclass": ("accuracy",)}


def subgroup_metrics(df: DataFrame, y: str, kind: str, attributes: Sequence[str], *,
                     score: str | None = None, pred: str | Column | None = None,
                     threshold: float = 0.5, min_group_size: int = MIN_GROUP_SIZE,
                     with_auc: bool = True) -> DataFrame:
    """One row per (attribute, grp) with n >= ``min_group_size``.

    binary: n, prevalence, selection_rate, tpr, fpr (denominator max(N, 1)),
    precision, roc_auc (null for one class); ``pred`` defaults to
    ``score >= threshold`` (pass a per-group decision column for the mitigated
    audit). regression: mae, mean_residual. multiclass: accuracy. ``with_auc=False``
    leaves out the grouped ROC-AUC (its ordered sums start work eagerly, so
    callers that do not use it should say so).
    """
    attrs = [a for a in attributes if a in df.columns]
    if kind == "binary":
        p = E.col(pred) if pred is not None else (F.col(score) >= F.lit(float(threshold)))
        base = df.select(*attrs, F.col(y).cast("int").alias("__y"), F.col(score).cast("double").alias("__s"),
                         p.cast("int").alias("__p"))
        long = long_attributes(base, attrs, ["__y", "__s", "__p"])
        yy, pp = F.col("__y"), F.col("__p")
        g = long.groupBy("attribute", "grp").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(yy.cast("double")).alias("prevalence"),
            F.avg(pp.cast("double")).alias("selection_rate"),
            F.count_if((yy == 1) & (pp == 1)).cast("double").alias("tp"),
            F.count_if((yy == 0) & (pp == 1)).cast("double").alias("fp"),
            F.count_if(yy == 1).cast("double").alias("n_pos"),
            F.count_if(yy == 0).cast("double").alias("n_neg"),
        ).where(F.col("n") >= min_group_size)
        cols = ["attribute", "grp", "n", "prevalence", "selection_rate",
                E.safe_div(F.col("tp"), F.col("n_pos")).alias("tpr"),
                (F.col("fp") / F.greatest(F.col("n_neg"), F.lit(1.0))).alias("fpr"),
                E.safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision")]
        if not with_auc:
            return g.select(*cols)
        auc = roc_auc(long, "__y", "__s", ["attribute", "grp"]).select("attribute", "grp", "roc_auc")
        return g.join(auc, ["attribute", "grp"], "left").select(*cols, "roc_auc")
    base = df.select(*attrs, F.col(y).alias("__y"), E.col(pred).alias("__p"))
    long = long_attributes(base, attrs, ["__y", "__p"])
    if kind == "regression":
        r = F.col("__y").cast("double") - F.col("__p").cast("double")
        g = long.groupBy("attribute", "grp").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("mean_residual"))
    elif kind == "multiclass":
        g = long.groupBy("attribute", "grp").agg(
            F.count(F.lit(1)).alias("n"), F.avg((F.col("__y") == F.col("__p")).cast("double")).alias("accuracy"))
    else:
        raise ValueError(f"unknown task kind '{kind}'")
    return g.where(F.col("n") >= min_group_size)


def fairness_summary(groups: DataFrame, kind: str) -> DataFrame:
    """Max − min gaps per attribute; disparate-impact ratio (only
    when the max selection rate is > 0) and the four-fifths flag."""
    mets = [m for m in GAP_METRICS[kind] if m in groups.columns]
    aggs = [(F.max(m) - F.min(m)).alias(f"{m}_gap") for m in mets]
    if kind == "binary":
        aggs += [F.min("selection_rate").alias("__mn"), F.max("selection_rate").alias("__mx")]
    s = groups.groupBy("attribute").agg(*aggs)
    if kind == "binary":
        dir_ = F.when(F.col("__mx") > 0, F.col("__mn") / F.col("__mx"))
        s = s.withColumns({"disparate_impact_ratio": dir_,
                           "four_fifths_flag": dir_ < F.lit(0.8)}).drop("__mn", "__mx")
    return s


def recall_gap(groups: DataFrame) -> DataFrame:
    """Recall gap per attribute with null recall counted as 0."""
    t = F.coalesce(F.col("tpr"), F.lit(0.0))
    return groups.groupBy("attribute").agg((F.max(t) - F.min(t)).alias("recall_gap"))


def before_after(before: DataFrame, after: DataFrame, how: str = "inner",
                 metrics: Sequence[str] = ("tpr", "selection_rate")) -> DataFrame:
    """before/after comparison joined on (attribute, grp)."""
    b = before.select("attribute", "grp", *[F.col(m).alias(f"{m}_before") for m in metrics])
    a = after.select("attribute", "grp", *[F.col(m).alias(f"{m}_after") for m in metrics])
    return b.join(a, ["attribute", "grp"], how)


def metrics_long(groups: DataFrame) -> DataFrame:
    """Wide group table → (attribute, grp, metric, value), nulls dropped."""
    vals = [c for c in groups.columns if c not in ("attribute", "grp")]
    w = groups.select("attribute", "grp", *[F.col(c).cast("double").alias(c) for c in vals])
    return w.unpivot(["attribute", "grp"], vals, "metric", "value").where(F.col("value").isNotNull())


def attribute_slice(groups: DataFrame, attribute: str) -> DataFrame:
    """rows of one attribute."""
    return groups.where(F.col("attribute") == attribute)


def audit(df: DataFrame, y: str, kind: str, attributes: Sequence[str], *, score: str | None = None,
          pred: str | Column | None = None, threshold: float = 0.5, group_thresholds: DataFrame | None = None,
          mitigation_attribute: str | None = None, min_group_size: int = MIN_GROUP_SIZE) -> dict:
    """Audit under the global threshold; with per-group thresholds also the mitigated
    audit, both summaries, the before/after join and overall before / after rows (T6)."""
    from cohortlens.operators.thresholds import apply_group_thresholds, overall_metrics
    groups = subgroup_metrics(df, y, kind, attributes, score=score, pred=pred, threshold=threshold,
                              min_group_size=min_group_size)
    out = {"groups": groups, "summary": fairness_summary(groups, kind)}
    if kind == "binary" and group_thresholds is not None and mitigation_attribute in df.columns:
        m = apply_group_thresholds(df, score, mitigation_attribute, group_thresholds, threshold)
        after_pred = F.col("mitigated.at_risk")
        # thresholds change decisions, not scores: the grouped AUC is the one computed above
        after = subgroup_metrics(m, y, kind, attributes, score=score, pred=after_pred,
                                 min_group_size=min_group_size, with_auc=False).join(
            groups.select("attribute", "grp", "roc_auc"), ["attribute", "grp"], "left")
        before_flag = (F.col(score) >= F.lit(float(threshold))).cast("int")
        both = m.select(F.col(y), before_flag.alias("__b"), after_pred.cast("int").alias("__a"))
        out["mitigated"] = {
            "groups": after, "summary": fairness_summary(after, kind),
            "before_after": before_after(groups, after, "inner"),
            "overall_before": overall_metrics(both, y, "__b"),
            "overall_after": overall_metrics(both, y, "__a"),
        }
    return out
