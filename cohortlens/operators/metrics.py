"""Evaluation metrics over a scored DataFrame.

Every metric is an aggregate and takes optional group ``keys``. Ranking
metrics (ROC-AUC, average precision, curves) first collapse rows to counts
per distinct score — partial aggregation, so ties and hot scores cost one row
— then use :func:`running_totals` for the ordered sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import expr as E
from cohortlens.operators.joins import join_dimension
from cohortlens.operators.ordered import quantiles, running_totals

EPS = float(np.finfo(np.float64).eps)


def _keys(keys: Sequence[str] | None) -> list[str]:
    return list(keys or [])


def score_counts(df: DataFrame, y: str, score: str, keys: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """(keys, score, pos, neg): rows per distinct score, nulls dropped; ``rows``: how many rows each one stands for."""
    s = F.col(score).cast("double")
    lab = F.col(y).cast("int")
    n = F.col(rows) if rows else F.lit(1)
    return (df.where(s.isNotNull() & ~F.isnan(s) & lab.isNotNull())
            .groupBy(*keys, s.alias("score"))
            .agg(F.sum(lab * n).cast("double").alias("pos"),
                 F.sum((F.lit(1) - lab) * n).cast("double").alias("neg")))


# ----------------------------------------------------------------------------- M1, M2

def regression_metrics(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """M1: r2, rmse, mae, mape (denominator max(y, 1), ×100), residual_std (ddof 0)."""
    yy, pp = F.col(y).cast("double"), F.col(pred).cast("double")
    r = yy - pp
    g = df.where(yy.isNotNull() & pp.isNotNull()).groupBy(*_keys(keys)).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(r * r).alias("sse"),
        (F.var_pop(yy) * F.count(F.lit(1))).alias("sst"),
        F.avg(F.abs(r)).alias("mae"),
        (F.avg(F.abs(r) / F.greatest(yy, F.lit(1.0))) * 100.0).alias("mape"),
        F.stddev_pop(r).alias("residual_std"),
    )
    return g.select(
        *_keys(keys), "n",
        F.when(F.col("sst") > 0, F.lit(1.0) - F.col("sse") / F.col("sst"))
         .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", "mape", "residual_std")


def interval_bounds(pred: Column, q: Column | float, lo: float | None = 0.0,
                    hi: float | None = 100.0) -> tuple[Column, Column]:
    """``[p - q, p + q]`` clipped to the declared bounds."""
    qq = q if isinstance(q, Column) else F.lit(float(q))
    lower, upper = pred - qq, pred + qq
    if lo is not None:
        lower = F.greatest(lower, F.lit(float(lo)))
    if hi is not None:
        upper = F.least(upper, F.lit(float(hi)))
    return lower, upper


def interval_coverage(df: DataFrame, y: str, pred: str, q: Column | float, alpha: float,
                      lo: float | None = 0.0, hi: float | None = 100.0,
                      keys: Sequence[str] = ()) -> DataFrame:
    """M2: empirical coverage, nominal coverage and mean width."""
    lower, upper = interval_bounds(F.col(pred).cast("double"), q, lo, hi)
    yy = F.col(y).cast("double")
    return df.groupBy(*_keys(keys)).agg(
        F.avg(((yy >= lower) & (yy <= upper)).cast("double")).alias("coverage"),
        F.lit(1.0 - alpha).alias("nominal_coverage"),
        F.avg(upper - lower).alias("mean_width"))


def interval_rows(df: DataFrame, y: str, pred: str, q: Column | float,
                  lo: float | None = 0.0, hi: float | None = 100.0) -> DataFrame:
    """Every row with its band and covered flag (callers order by prediction)."""
    lower, upper = interval_bounds(F.col(pred).cast("double"), q, lo, hi)
    yy = F.col(y).cast("double")
    return df.select("*", lower.alias("lower"), upper.alias("upper"),
                     ((yy >= lower) & (yy <= upper)).cast("int").alias("covered"))


# ----------------------------------------------------------------------------- ranking metrics

def roc_auc(df: DataFrame, y: str, score: str, keys: Sequence[str] = (),
            n_buckets: int | None = None, rows: str | None = None) -> DataFrame:
    """ROC-AUC with ties counted half; null when a key has one class only. ``rows``: how many rows each one stands for."""
    k = _keys(keys)
    cum = running_totals(score_counts(df, y, score, k, rows), k, ["score"], ["neg"], n_buckets=n_buckets)
    g = cum.groupBy(*k).agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0)).alias("__s"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.select(*k, F.try_divide(F.col("__s"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
                    F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def _desc_counts(df: DataFrame, y: str, score: str, keys: list[str],
                 n_buckets: int | None) -> DataFrame:
    """(keys, score, pos, neg, tp, fp, P, N): cumulative counts at ``score >= s``."""
    sc = score_counts(df, y, score, keys)
    cum = running_totals(sc, keys, ["score"], ["pos", "neg"], descending=True, n_buckets=n_buckets)
    tot = sc.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = cum.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    if keys:
        # one row per key: broadcast behind a size check (a hot key must not
        # pull a third of the rows into one join task)
        return join_dimension(cum, tot, keys)
    t = tot.select(F.struct("P", "N")).scalar()
    return cum.withColumns({"P": t["P"], "N": t["N"]})


def average_precision(df: DataFrame, y: str, score: str, keys: Sequence[str] = (),
                      n_buckets: int | None = None) -> DataFrame:
    """M4: step-wise average precision Σ ΔR · P over descending distinct scores."""
    k = _keys(keys)
    c = _desc_counts(df, y, score, k, n_buckets)
    return c.groupBy(*k).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))),
                     F.first("P")).alias("average_precision"))


def roc_points(df: DataFrame, y: str, score: str, keys: Sequence[str] = (),
               n_buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the (0, 0) start."""
    k = _keys(keys)
    c = _desc_counts(df, y, score, k, n_buckets)
    pts = c.select(*k, F.col("score").alias("threshold"),
                   E.safe_div(F.col("fp"), F.col("N"), None).alias("fpr"),
                   E.safe_div(F.col("tp"), F.col("P"), None).alias("tpr"))
    start = c.groupBy(*k).agg(F.lit(float("inf")).alias("threshold"),
                              F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_points(df: DataFrame, y: str, score: str, keys: Sequence[str] = (),
              n_buckets: int | None = None) -> DataFrame:
    """(threshold, recall, precision) per distinct score, plus the final (0, 1) point."""
    k = _keys(keys)
    c = _desc_counts(df, y, score, k, n_buckets)
    pts = c.select(*k, F.col("score").alias("threshold"),
                   F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"),
                   E.safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
    end = c.groupBy(*k).agg(F.lit(None).cast("double").alias("threshold"),
                            F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return pts.unionByName(end)


def calibration_curve(df: DataFrame, y: str, score: str, n_bins: int = 10,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Quantile bins (right-closed: bin = #inner edges < p), empty bins dropped."""
    k = _keys(keys)
    s = F.col(score).cast("double")
    data = df.where(s.isNotNull() & ~F.isnan(s))
    probs = [i * 100.0 / n_bins / 100.0 for i in range(n_bins + 1)]
    edges = quantiles(data, score, probs, keys=k)
    inner = edges.where((F.col("prob") > 0) & (F.col("prob") < 1)).groupBy(*k).agg(
        F.sort_array(F.collect_list("value")).alias("__inner"))  # n_bins - 1 values per key
    if k:
        tagged = join_dimension(data, inner, k)
    else:
        tagged = data.withColumn("__inner", inner.select("__inner").scalar())
    b = F.size(F.filter("__inner", lambda e: e < s))
    return (tagged.groupBy(*k, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("prob_pred"),
        F.avg(F.col(y).cast("double")).alias("prob_true")))


def sweep_grid(lo: float = 0.05, hi: float = 0.95, n: int = 91) -> list[float]:
    return [float(v) for v in np.linspace(lo, hi, n)]


def threshold_sweep(df: DataFrame, y: str, score: str, grid: Sequence[float] | None = None,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 at each grid threshold (``score >= t``).

    No cross join: each row finds how many grid values it reaches (binary
    search, JVM side) and counts are aggregated per grid index ``j``. That
    table has at most ``len(grid) + 1`` rows per key; spreading it over the
    grid indices it reaches gives the counts at every threshold.
    """
    k = _keys(keys)
    grid = list(grid or sweep_grid())
    s = F.col(score).cast("double")
    data = df.where(s.isNotNull() & ~F.isnan(s)).withColumn("__s", s)
    bz = Bucketizer(splits=[float("-inf"), *grid, float("inf")], inputCol="__s", outputCol="__j")
    lab = F.col(y).cast("int")
    per = bz.transform(data).groupBy(*k, F.col("__j").cast("int").alias("j")).agg(
        F.sum(lab).cast("double").alias("pos"), F.sum(F.lit(1) - lab).cast("double").alias("neg"))
    # a row with index j satisfies score >= grid[i] for every i < j
    spread = per.select(*k, "j", "pos", "neg",
                        F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("i"))
    reach = F.col("i") < F.col("j")
    agg = spread.groupBy(*k, "i").agg(
        F.sum(F.when(reach, F.col("pos")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(reach, F.col("neg")).otherwise(0.0)).alias("fp"),
        F.sum("pos").alias("P"))  # every j-row appears once per i
    thr = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("i") + 1)
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("P")
    return agg.select(*k, thr.alias("threshold"),
                      E.safe_div(tp, tp + fp).alias("precision"),
                      E.safe_div(tp, P).alias("recall"),
                      E.f_beta(tp, fp, P - tp, 1.0).alias("f1"))


# ----------------------------------------------------------------------------- threshold metrics

def _confusion(y: str, pred: Column) -> list[Column]:
    lab, pr = F.col(y).cast("int"), pred.cast("int")
    cells = {"tp": (1, 1), "fp": (0, 1), "tn": (0, 0), "fn": (1, 0)}
    return [F.count_if((lab == a) & (pr == b)).cast("double").alias(c) for c, (a, b) in cells.items()]


def confusion_counts(df: DataFrame, y: str, pred: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*_keys(keys)).agg(*_confusion(y, pred))


def binary_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5,
                   keys: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """M23 (binary): ranking metrics + confusion metrics at ``threshold``, one row per key."""
    k = _keys(keys)
    s = F.col(score).cast("double")
    lab = F.col(y).cast("double")
    p1 = F.least(F.greatest(s, F.lit(EPS)), F.lit(1.0 - EPS))
    base = df.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((s - lab) * (s - lab)).alias("brier"),
        F.avg(-F.when(lab == 1, F.log(p1)).otherwise(F.log(F.lit(1.0) - p1))).alias("log_loss"),
        F.avg(lab).alias("positive_rate"),
        F.avg((s >= F.lit(threshold)).cast("double")).alias("flagged_rate"),
        *_confusion(y, s >= F.lit(threshold)))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec = E.safe_div(tp, tp + fp)
    rec = E.safe_div(tp, tp + fn)
    tnr = F.try_divide(tn, tn + fp)
    tpr = F.try_divide(tp, tp + fn)
    out = base.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": F.coalesce((tpr + tnr) / 2.0, tpr, tnr),
        "precision": prec, "recall": rec,
        "f1": E.f_beta(tp, fp, fn, 1.0),
        "f2": E.safe_div(5.0 * prec * rec, F.greatest(4.0 * prec + rec, F.lit(1e-12)))}).drop("tp", "fp", "tn", "fn")
    # ROC-AUC and AP from one descending cumulative table:
    # negatives strictly below s = N - fp(s), fp(s) counting scores >= s
    c = _desc_counts(df, y, score, k, n_buckets)
    rank = c.groupBy(*k).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0)),
                     F.first("P") * F.first("N")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))),
                     F.first("P")).alias("average_precision"))
    return _beside(out, rank, k).withColumn("threshold", F.lit(float(threshold)))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of ``right`` beside those of ``left``: by key, or one row as a scalar subquery."""
    if keys:
        return left.join(right, keys)
    one = right.select(F.struct(*right.columns).alias("__one"))
    return left.withColumn("__one", one.scalar()).select(*left.columns, "__one.*")


def long_metrics(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wide metric row(s) → ``(keys, metric, value)``."""
    k = _keys(keys)
    vals = [c for c in wide.columns if c not in k]
    w = wide.select(*k, *[F.col(c).cast("double").alias(c) for c in vals])
    return w.unpivot(k, vals, "metric", "value")


# ----------------------------------------------------------------------------- multiclass

def class_table(df: DataFrame, y: str, pred: str, keys: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Per class (labels = union of true and predicted): tp, support, predicted count. ``rows``: how many rows each one stands for."""
    k = _keys(keys)
    cells = df.groupBy(*k, F.col(y).alias("__y"), F.col(pred).alias("__p")).agg(
        (F.sum(rows) if rows else F.count(F.lit(1))).alias("c"))
    roles = cells.select(*k, F.explode(F.array(
        F.struct(F.col("__y").alias("cls"), F.col("c").alias("support"), F.lit(0).alias("predicted"),
                 F.when(F.col("__y") == F.col("__p"), F.col("c")).otherwise(0).alias("tp")),
        F.struct(F.col("__p").alias("cls"), F.lit(0).alias("support"), F.col("c").alias("predicted"),
                 F.lit(0).alias("tp")))).alias("r")).select(*k, "r.*")
    return roles.groupBy(*k, "cls").agg(
        F.sum("tp").cast("double").alias("tp"), F.sum("support").cast("long").alias("support"),
        F.sum("predicted").cast("double").alias("predicted"))


def class_report(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro and weighted rows."""
    k = _keys(keys)
    t = class_table(df, y, pred, k)
    per = t.select(*k, F.col("cls").cast("string").alias("label"),
                   E.safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                   E.safe_div(F.col("tp"), F.col("support").cast("double")).alias("recall"),
                   E.safe_div(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
                   "support", "tp")
    n = F.sum("support")
    acc = per.groupBy(*k).agg((F.sum("tp") / n).alias("a"), n.alias("s")).select(
        *k, F.lit("accuracy").alias("label"), F.col("a").alias("precision"), F.col("a").alias("recall"),
        F.col("a").alias("f1"), F.col("s").cast("long").alias("support"))
    macro = per.groupBy(*k).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        n.cast("long").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = per.groupBy(*k).agg(
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("precision", "recall", "f1")],
        n.cast("long").alias("support")).withColumn("label", F.lit("weighted avg"))
    cols = [*k, "label", "precision", "recall", "f1", "support"]
    return (per.select(*cols).unionByName(acc.select(*cols))
            .unionByName(macro.select(*cols)).unionByName(weighted.select(*cols)))


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Dense (true, predicted, n) over the union of labels; zero cells kept."""
    cells = df.groupBy(F.col(y).alias("y_true"), F.col(pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    labels = cells.select(F.explode(F.array("y_true", "y_pred")).alias("l")).agg(
        F.array_sort(F.collect_set("l")).alias("ls"))  # bounded by the number of classes
    arr = labels.select("ls").scalar()
    spark = df.sparkSession
    grid = (spark.range(1).select(F.explode(arr).alias("y_true"))
            .select("y_true", F.explode(arr).alias("y_pred")))
    return (grid.join(cells, ["y_true", "y_pred"], "left")
            .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def multiclass_metrics(df: DataFrame, y: str, prob_cols: Sequence[str],
                       keys: Sequence[str] = (), n_buckets: int | None = None) -> DataFrame:
    """M7, M11, M12, M6 (multiclass): accuracy, balanced accuracy, macro / weighted F1,
    one-vs-rest macro ROC-AUC and log loss; prediction = argmax of the probabilities."""
    k = _keys(keys)
    probs = F.array(*[F.col(c).cast("double") for c in prob_cols])
    pred = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    lab = F.col(y).cast("int")
    scored = df.select(*k, lab.alias("__y"), probs.alias("__probs"), pred.alias("__pred"))
    t = class_table(scored, "__y", "__pred", k)
    f1 = E.safe_div(2.0 * F.col("tp"), F.col("predicted") + F.col("support"))
    n = F.sum("support")
    cls = t.groupBy(*k).agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced_accuracy"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("support")) / n).alias("f1_weighted"))
    py = F.least(F.greatest(F.element_at("__probs", F.col("__y") + 1), F.lit(EPS)), F.lit(1.0 - EPS))
    ll = scored.groupBy(*k).agg(F.avg(-F.log(py)).alias("log_loss"))
    ovr_in = scored.select(*k, F.posexplode("__probs").alias("cls", "p"), "__y").select(
        *k, F.col("cls").cast("string").alias("__cls"), (F.col("__y") == F.col("cls")).cast("int").alias("yb"),
        "p")
    auc = roc_auc(ovr_in, "yb", "p", [*k, "__cls"], n_buckets).groupBy(*k).agg(
        F.avg("roc_auc").alias("roc_auc_ovr"))
    return _beside(_beside(cls, auc, k), ll, k)
