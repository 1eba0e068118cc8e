"""Decision thresholds: target recall, F-beta, per-group.

The candidate grid is the set of scores rounded to 4 decimals (NumPy
half-even) and the rule compares *raw* scores with the rounded threshold. For a
probability the grid has at most 10,001 values per key, so after one
aggregate the search runs on a table of bounded size.

Counting ``score >= g`` for every grid value ``g`` needs no join: a raw score
rounding to ``g' > g`` is always ``> g`` and one rounding to ``g' < g`` is
always ``< g``, so the count is a suffix sum over grid cells plus the part of
cell ``g`` itself that is ``>= g``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import expr as E
from cohortlens.functions.domain import MIN_POSITIVES
from cohortlens.operators.joins import join_dimension


def _k(keys) -> list[str]:
    return list(keys or [])


def grid_counts(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, g, tp, fp, P, N): counts of positives / negatives with raw score >= g."""
    k = _k(keys)
    s = F.col(score).cast("double")
    g = E.round_half_even(s, 4)
    lab = F.col(y).cast("int")
    cells = (df.where(s.isNotNull() & ~F.isnan(s))
             .groupBy(*k, g.alias("g")).agg(
                 F.sum(lab).cast("double").alias("pos"),
                 F.sum(F.lit(1) - lab).cast("double").alias("neg"),
                 F.sum(F.when(s >= g, lab).otherwise(0)).cast("double").alias("pos_ge"),
                 F.sum(F.when(s >= g, F.lit(1) - lab).otherwise(0)).cast("double").alias("neg_ge")))
    above = Window.partitionBy(*k).orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*k)
    return cells.select(
        *k, "g",
        (F.coalesce(F.sum("pos").over(above), F.lit(0.0)) + F.col("pos_ge")).alias("tp"),
        (F.coalesce(F.sum("neg").over(above), F.lit(0.0)) + F.col("neg_ge")).alias("fp"),
        F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))


def threshold_at_recall(df: DataFrame, y: str, score: str, target_recall: float = 0.8,
                        keys: Sequence[str] = (), default: float | None = 0.5) -> DataFrame:
    """Highest grid threshold whose recall is still >= target.

    Fallback: ``default`` (T1 uses 0.5) or, with ``default=None``, the smallest
    grid value (T4). Returns ``(keys, threshold)``.
    """
    k = _k(keys)
    gc = grid_counts(df, y, score, k)
    recall = E.safe_div(F.col("tp"), F.col("P"))
    best = gc.groupBy(*k).agg(F.max(F.when(recall >= F.lit(float(target_recall)), F.col("g"))).alias("b"),
                              F.min("g").alias("gmin"))
    fb = F.col("gmin") if default is None else F.lit(float(default))
    return best.select(*k, F.coalesce(F.col("b"), fb).alias("threshold"))


def threshold_fbeta(df: DataFrame, y: str, score: str, beta: float = 2.0,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Grid threshold maximising F-beta; the lowest threshold wins ties."""
    k = _k(keys)
    gc = grid_counts(df, y, score, k)
    f = E.f_beta(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"), beta)
    best = gc.groupBy(*k).agg(F.max(F.struct(f.alias("f"), (-F.col("g")).alias("ng"))).alias("m"))
    return best.select(*k, (-F.col("m.ng")).alias("threshold"))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Bring per-key columns of ``small`` onto ``df`` (scalar subqueries when there are no keys)."""
    k = _k(keys)
    if not k:
        return df.withColumns({c: small.select(c).scalar() for c in cols})
    return join_dimension(df, small.select(*k, *cols), k, "left")


def stats_at_threshold(df: DataFrame, y: str, score: str, thresholds: DataFrame,
                       keys: Sequence[str] = (), beta: float = 2.0) -> DataFrame:
    """Recall, precision, flagged rate and F-beta at the chosen threshold per key."""
    k = _k(keys)
    d = attach(df, thresholds, k, ["threshold"])
    pred = (F.col(score).cast("double") >= F.col("threshold")).cast("int")
    lab = F.col(y).cast("int")
    c = d.groupBy(*k).agg(
        F.first("threshold").alias("threshold"),
        F.count_if((lab == 1) & (pred == 1)).cast("double").alias("tp"),
        F.count_if((lab == 0) & (pred == 1)).cast("double").alias("fp"),
        F.count_if((lab == 1) & (pred == 0)).cast("double").alias("fn"),
        F.avg(pred.cast("double")).alias("flagged_rate"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*k, "threshold",
                    E.safe_div(tp, tp + fn).alias("recall"),
                    E.safe_div(tp, tp + fp).alias("precision"),
                    "flagged_rate",
                    E.f_beta(tp, fp, fn, beta).alias("fbeta"))


def optimise_threshold(df: DataFrame, y: str, score: str, strategy: str = "target_recall",
                       target_recall: float = 0.8, beta: float = 2.0,
                       keys: Sequence[str] = ()) -> DataFrame:
    """T1-T3 in one call: the chosen threshold with its statistics."""
    if strategy == "target_recall":
        t = threshold_at_recall(df, y, score, target_recall, keys, default=0.5)
    elif strategy == "fbeta":
        t = threshold_fbeta(df, y, score, beta, keys)
    else:
        raise ValueError(f"Unknown threshold strategy '{strategy}'")
    return stats_at_threshold(df, y, score, t, keys, beta).withColumn("strategy", F.lit(strategy))


def group_thresholds(df: DataFrame, y: str, score: str, group: str, target_recall: float,
                     default: float | Column, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """T5: per-group threshold at target recall; groups with < ``min_positives``
    positives keep ``default``. Returns the calibration table
    ``(attribute, grp, n, n_positive, threshold, recall, precision, flagged_rate)``."""
    # groups are compared as text; a missing group value is its own group ("nan")
    d = df.withColumn("grp", F.coalesce(F.col(group).cast("string"), F.lit("nan")))
    fitted = threshold_at_recall(d, y, score, target_recall, ["grp"], default=None)
    sizes = d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.col(y).cast("long")).alias("n_positive"))
    thr = sizes.join(fitted, "grp", "left").select(
        "grp", "n", "n_positive",
        F.when(F.col("n_positive") >= min_positives, F.col("threshold"))
         .otherwise(default if isinstance(default, Column) else F.lit(float(default))).alias("threshold"))
    st = stats_at_threshold(d, y, score, thr.select("grp", "threshold"), ["grp"])
    return (thr.join(st.drop("threshold", "fbeta"), "grp")
            .select(F.lit(group).alias("attribute"), "grp", "n", "n_positive", "threshold",
                    "recall", "precision", "flagged_rate"))


def apply_group_thresholds(df: DataFrame, score: str, group: str, thresholds: DataFrame,
                           default: float, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Flag at the group's threshold, unknown group → default; adds a
    ``mitigated`` struct (attribute, threshold, at_risk). The threshold table
    has one row per group and is broadcast only within ``max_broadcast_rows``."""
    t = thresholds.select(F.col("grp").alias("__g"), F.col("threshold").alias("__t"))
    g = F.coalesce(F.col(group).cast("string"), F.lit("nan"))
    j = join_dimension(df, t, g == F.col("__g"), "left", max_broadcast_rows)
    thr = F.coalesce(F.col("__t"), F.lit(float(default)))
    return j.withColumn("mitigated", F.struct(
        F.lit(group).alias("attribute"), thr.alias("threshold"),
        (F.col(score) >= thr).alias("at_risk"))).drop("__g", "__t")


def flag(score: str | Column, threshold: float = 0.5) -> Column:
    """``p >= t``."""
    return E.col(score) >= F.lit(float(threshold))


def overall_metrics(df: DataFrame, y: str, pred: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, flagged rate, FPR (denominator max(N, 1))."""
    k = _k(keys)
    lab = F.col(y).cast("int")
    p = E.col(pred).cast("int")
    c = df.groupBy(*k).agg(
        F.count_if((lab == 1) & (p == 1)).cast("double").alias("tp"),
        F.count_if((lab == 0) & (p == 1)).cast("double").alias("fp"),
        F.count_if(lab == 1).cast("double").alias("P"),
        F.count_if(lab == 0).cast("double").alias("N"),
        F.avg(p.cast("double")).alias("flagged_rate"))
    return c.select(*k, E.safe_div(F.col("tp"), F.col("P")).alias("recall"),
                    E.safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    "flagged_rate",
                    (F.col("fp") / F.greatest(F.col("N"), F.lit(1.0))).alias("fpr"))
