"""Attribution: Shapley values, global / local importance, permutation importance.

* Linear models (E1): ``coef · (x − background mean)`` per encoded column,
  as array expressions on the assembled vector — no UDF.
* Any model (E2): interventional Shapley values over source features. Values are linear in the
  coalitions' mean outputs, so one matrix (features × coalitions) gives them: Shapley's weights where all 2^f
  coalitions fit the budget, else the solution of kernel-weighted least squares over sampled
  coalitions (its normal equations depend on the coalitions only, which all rows share). Each distinct feature vector of
  the explained rows expands to coalitions × background rows (both bounded parameters); equal mixtures are
  summed before one ``transform`` scores them, a weighted sum per vector gives the values, and an
  equi-join on the vector hands them to every row holding it.
* Permutation importance (E5/J7): a column is permuted by pairing each row's
  rank in key order with another row's rank in hash order — an equi-join on
  rank, with ranks from the range-partitioned running count.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.operators.features import Task
from cohortlens.operators.joins import join_dimension
from cohortlens.operators.modeling import FEATURES_COL, LABEL_COL, encoding_of
from cohortlens.operators.ordered import running_totals
from cohortlens.session import cut_lineage

#: coalitions at most, besides two for each feature; and background rows
COALITIONS = 2048
MAX_BACKGROUND = 1000


def _linear_stage(model: PipelineModel):
    last = model.stages[-1]
    linear = hasattr(last, "coefficientMatrix") or hasattr(last, "coefficients")
    # a linear stage on derived features (random Fourier features) says nothing about the encoded columns
    if linear and last.getFeaturesCol() == FEATURES_COL:
        return last
    raise TypeError("linear attribution needs a linear final stage on the encoded columns")


def linear_contributions(model: PipelineModel, task: Task, rows: DataFrame, background: DataFrame,
                         key: str) -> DataFrame:
    """E1 + E6: long rows (key, encoded, source, value, contribution, magnitude).

    Binary: log-odds contributions of class 1; multiclass: of the predicted
    class; regression: of the prediction. ``magnitude`` is the absolute
    contribution, for multiclass averaged over all classes.
    """
    stage = _linear_stage(model)
    enc = encoding_of(model, task.inputs)
    bg = model.transform(background).select(vector_to_array(FEATURES_COL).alias("x"))
    means = bg.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(enc.encoded))]).first()
    mu = [float(means[f"m{i}"] or 0.0) for i in range(len(enc.encoded))]
    out = model.transform(rows).select(key, vector_to_array(FEATURES_COL).alias("x"),
                                       F.col("prediction").cast("int").alias("__pred"))
    if hasattr(stage, "coefficientMatrix") and stage.coefficientMatrix.numRows > 1:
        cm = stage.coefficientMatrix.toArray().tolist()
        coef = F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in cm]), F.col("__pred") + 1)
        size = [sum(abs(row[i]) for row in cm) / len(cm) for i in range(len(mu))]
    else:
        c = stage.coefficients.toArray().tolist()
        coef = F.array(*[F.lit(float(v)) for v in c])
        size = [abs(float(v)) for v in c]
    triples = F.arrays_zip(F.col("x").alias("x"), coef.alias("c"), F.array(*[F.lit(m) for m in mu]).alias("m"),
                           F.array(*[F.lit(v) for v in size]).alias("a"),
                           F.array(*[F.lit(e) for e in enc.encoded]).alias("encoded"),
                           F.array(*[F.lit(s) for s in enc.source]).alias("source"))
    return out.select(key, F.explode(triples).alias("t")).select(
        key, "t.encoded", "t.source", F.col("t.x").alias("value"),
        (F.col("t.c") * (F.col("t.x") - F.col("t.m"))).alias("contribution"),
        (F.col("t.a") * F.abs(F.col("t.x") - F.col("t.m"))).alias("magnitude"))


def global_importance(contrib: DataFrame) -> DataFrame:
    """Mean |value| (over all classes) per encoded column, then summed per source feature, sorted."""
    per_enc = contrib.groupBy("encoded", "source").agg(F.avg("magnitude").alias("mean_abs"))
    return per_enc.groupBy("source").agg(F.sum("mean_abs").alias("importance")).orderBy(F.desc("importance"))


def local_explanation(contrib: DataFrame, rows: DataFrame, key: str, top_k: int = 5) -> DataFrame:
    """E4 + O2: per row, signed sum per source feature, top-k by |value| with the raw value.

    The per-row array is sorted inside the row (no shuffle beyond the group-by
    that sums encoded columns of one row)."""
    per_src = contrib.groupBy(key, "source").agg(F.sum("contribution").alias("contribution"))
    raw = rows.select(key, *[F.col(c).cast("string").alias(c) for c in rows.columns if c != key])
    srcs = [c for c in rows.columns if c != key]
    raw_long = raw.unpivot([key], srcs, "source", "raw_value")
    j = per_src.join(raw_long, [key, "source"], "left")
    arr = j.groupBy(key).agg(F.collect_list(F.struct(
        F.abs("contribution").alias("abs"), F.col("source").alias("feature"), "contribution", "raw_value"))
        .alias("a"))  # one element per source feature of one row: bounded
    ordered = F.array_sort("a", lambda l, r: F.when(l["abs"] > r["abs"], -1).when(l["abs"] < r["abs"], 1)
                           .otherwise(0))
    return arr.select(key, F.slice(F.transform(ordered, lambda s: F.struct(
        s["feature"].alias("feature"), s["contribution"].alias("contribution"),
        s["raw_value"].alias("value"))), 1, top_k).alias("explanation"))


def _shap_weight(n: int, s: int) -> float:
    return math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)


def all_coalitions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every subset of ``n`` features as a row of booleans, and the matrix that takes their values to Shapley values."""
    masks = np.array([[bool(m >> i & 1) for i in range(n)] for m in range(2 ** n)])
    size = masks.sum(axis=1)
    to = np.zeros((n, len(masks)))
    for i in range(n):
        for j, s in enumerate(size):
            to[i, j] = _shap_weight(n, s - 1) if masks[j, i] else -_shap_weight(n, s)
    return masks, to


def sampled_coalitions(n: int, budget: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The empty and the whole set, all subsets of the outer sizes that the budget covers, and pairs of drawn subsets and
    their complements of the others (Lundberg & Lee, 2017); and the matrix of the constrained least squares over them."""
    half = [s for s in range(1, n // 2 + 1)]
    both = {s: 1 if 2 * s == n else 2 for s in half}
    share = {s: both[s] * (n - 1) / (s * (n - s)) for s in half}
    weight: dict[tuple[int, ...], float] = {}
    left, rest = budget, list(half)

    def add(subset: tuple[int, ...], w: float) -> None:
        weight[subset] = weight.get(subset, 0.0) + w

    while rest and math.comb(n, rest[0]) * both[rest[0]] <= left * share[rest[0]] / sum(share[s] for s in rest):
        s = rest.pop(0)
        number = math.comb(n, s) * both[s]
        for c in combinations(range(n), s):
            add(c, share[s] / number)
            if both[s] == 2:
                add(tuple(sorted(set(range(n)) - set(c))), share[s] / number)
        left -= number
    if rest:
        rng = random.Random(seed)
        draws = max(1, left // 2)
        w = sum(share[s] for s in rest) / (2 * draws)
        for _ in range(draws):
            s = rng.choices(rest, [share[s] for s in rest])[0]
            c = tuple(sorted(rng.sample(range(n), s)))
            add(c, w)
            add(tuple(sorted(set(range(n)) - set(c))), w)
    subsets = sorted(weight)
    z = np.array([[i in c for i in range(n)] for c in subsets], float)
    zw = z.T * np.array([weight[c] for c in subsets])
    inverse = np.linalg.pinv(zw @ z)
    h = inverse.sum(axis=1) / inverse.sum()
    g = (np.eye(n) - np.outer(h, np.ones(n))) @ inverse @ zw
    masks = np.vstack([np.zeros((1, n), bool), np.ones((1, n), bool), z.astype(bool)])
    return masks, np.column_stack([-g.sum(axis=1) - h, h, g])


def coalitions(n: int, budget: int = COALITIONS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions of ``n`` features (rows of booleans) and the matrix (n × coalitions) to the Shapley values."""
    return all_coalitions(n) if 2 ** n <= budget + 2 * n else sampled_coalitions(n, budget + 2 * n, seed)


def _model_outputs(task: Task) -> list:
    """What is explained: the probability of class 1, of every class, or the prediction."""
    if task.kind == "binary":
        return [vector_to_array("probability")[1]]
    if task.kind == "multiclass":
        return [vector_to_array("probability")[c] for c in range(len(task.levels))]
    return [F.col("prediction")]


def shapley_values(model: PipelineModel, task: Task, rows: DataFrame, background: DataFrame,
                   key: str, budget: int = COALITIONS, seed: int = 0) -> DataFrame:
    """Interventional Shapley values per (key, feature) for any fitted pipeline.

    Exact where all coalitions fit ``budget`` (up to 11 features by default), else by sampled coalitions.
    Multiclass: ``shap_value`` explains the probability of the class predicted for the explained row
    itself, in every coalition; ``magnitude`` is the mean absolute value over all classes.

    ``background`` holds at most MAX_BACKGROUND rows (e.g. from ``split.fixed_sample``); equal rows count together.
    """
    spark = rows.sparkSession
    feats = list(task.inputs)
    n = len(feats)
    bg_rows = background.select(*feats).limit(MAX_BACKGROUND + 1).count()
    if not 0 < bg_rows <= MAX_BACKGROUND:
        raise ValueError(f"background must hold 1 to {MAX_BACKGROUND} rows")
    types = dict(rows.select(*feats).dtypes)
    masks, to = coalitions(n, budget, seed)
    # both small tables enter the plan as one array each; no join
    bg = (background.select(*[F.col(f).cast(types[f]).alias(f) for f in feats]).groupBy(*feats).agg((F.count(F.lit(1)) / bg_rows).alias("__share"))
          .select(F.collect_list(F.struct(*feats, "__share"))).scalar())
    sets = (spark.createDataFrame([(m.tolist(), to[:, j].tolist()) for j, m in enumerate(masks)], "has array<boolean>, w array<double>")
            .select(F.collect_list(F.struct("has", "w"))).scalar())
    # outputs depend on the row only through its feature vector: explain each distinct
    # vector once (a partial + final aggregate, so a vector held by a third of the
    # rows is one row) and join the values back to the rows afterwards.
    vid = [f"__x_{f}" for f in feats]
    vecs = rows.select(*[F.col(f).alias(c) for f, c in zip(feats, vid)]).distinct()
    if task.kind == "multiclass":
        own = model.transform(vecs.select(*vid, *[F.col(c).alias(f) for f, c in zip(feats, vid)]))
        vecs = own.select(*vid, F.col("prediction").cast("int").alias("__class"))
    else:
        vecs = vecs.withColumn("__class", F.lit(0))
    hyb = vecs.withColumn("__s", F.explode(sets)).withColumn("__b", F.explode(bg))
    # mixtures with equal values have one output: their weights for each feature are summed first
    mixed = hyb.select(*vid, "__class", *[
        F.when(F.col("__s.has")[i], F.col(c)).otherwise(F.col("__b")[f]).alias(f) for i, (f, c) in enumerate(zip(feats, vid))],
        *[(F.col("__s.w")[i] * F.col("__b.__share")).alias(f"__w{i}") for i in range(n)])
    mixed = mixed.groupBy(*vid, "__class", *feats).agg(*[F.sum(f"__w{i}").alias(f"__w{i}") for i in range(n)])
    out = model.transform(mixed)
    outputs = _model_outputs(task)
    phi = [F.array(*[F.sum(F.col(f"__w{i}") * o) for o in outputs]) for i in range(n)]
    per_vec = (out.groupBy(*vid, "__class").agg(F.array(*phi).alias("__phi"))
               .select(*vid, "__class", F.posexplode("__phi").alias("__i", "phi"))
               .select(*vid, F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("__i") + 1).alias("feature"),
                       F.element_at("phi", F.col("__class") + 1).alias("shap_value"),
                       (F.aggregate("phi", F.lit(0.0), lambda s, x: s + F.abs(x)) / len(outputs)).alias("magnitude")))
    # back to the rows: null-safe equality on the feature vector; the per-vector table is
    # broadcast only within the checked bound, else a shuffle join (AQE splits hot vectors)
    r = rows.select(key, *feats)
    cond = reduce(lambda a, b: a & b, [r[f].eqNullSafe(per_vec[c]) for f, c in zip(feats, vid)])
    return join_dimension(r, per_vec, cond).select(key, "feature", "shap_value", "magnitude")


def permutation_importance(model: PipelineModel, task: Task, data: DataFrame, key: str,
                           n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """E5 + J7: decrease of the task metric when one feature is permuted; mean and
    population std over repeats, sorted. Metric: ROC-AUC (binary), macro-F1
    (multiclass), R² (regression).

    With classes, the score depends on a row only through its label and feature values: rows and pairs
    of rows with equal ones are counted before they are copied for each feature and scored."""
    feats = list(task.inputs)
    classes = task.kind != "regression"
    rows = "__rows" if classes else None
    base_cols = [key, LABEL_COL, *feats]
    d = data.select(*base_cols).withColumn("__one", F.lit(1))
    ranked = cut_lineage(running_totals(d, [], [key], ["__one"], prefix="__r").withColumnRenamed("__r__one", "__rk").drop("__one"))
    reps = ranked.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))))
    donors = reps.withColumns({"__h": F.xxhash64(F.col(key), F.lit(seed) + F.col("repeat")), "__one": F.lit(1)})
    donors = running_totals(donors.drop("__rk", LABEL_COL), ["repeat"], ["__h", key], ["__one"], prefix="__d") \
        .withColumnRenamed("__d__one", "__rk")
    donor_vals = donors.select("repeat", "__rk", *[F.col(f).alias(f"__donor_{f}") for f in feats])
    # equi-join on (repeat, rank); both sides hold every row once a repeat, which the planner's guess from the size of the files
    # leaves out, so it must not choose a broadcast
    paired = reps.join(donor_vals.hint("merge"), ["repeat", "__rk"])
    base = data.select(*base_cols)
    if classes:
        counted = F.count(F.lit(1)).alias(rows)
        paired = paired.groupBy("repeat", LABEL_COL, *feats, *[f"__donor_{f}" for f in feats]).agg(counted)
        base = base.groupBy(LABEL_COL, *feats).agg(counted)
    copies = paired.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in feats])))
    permuted = copies.select(*([rows] if classes else [key]), LABEL_COL, "repeat", "feature", *[
        F.when(F.col("feature") == f, F.col(f"__donor_{f}")).otherwise(F.col(f)).alias(f) for f in feats])
    if classes:
        permuted = permuted.groupBy(LABEL_COL, "repeat", "feature", *feats).agg(F.sum(rows).alias(rows))
    base, perm = model.transform(base), model.transform(permuted)

    def metric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        if task.kind == "binary":
            s = df.withColumn("__p", vector_to_array("probability")[1])
            return M.roc_auc(s, LABEL_COL, "__p", keys, rows=rows).select(*keys, F.col("roc_auc").alias("score"))
        if task.kind == "regression":
            return M.regression_metrics(df, LABEL_COL, "prediction", keys).select(*keys, F.col("r2").alias("score"))
        t = M.class_table(df, LABEL_COL, "prediction", keys, rows)
        f1 = F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support"))
        return t.groupBy(*keys).agg(F.avg(F.coalesce(f1, F.lit(0.0))).alias("score"))

    base_score = metric(base, []).select("score").scalar()
    drops = metric(perm, ["feature", "repeat"]).withColumn("drop", base_score - F.col("score"))
    return (drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                         F.stddev_pop("drop").alias("importance_std"))
            .orderBy(F.desc("importance_mean")))


def beeswarm(contrib: DataFrame) -> DataFrame:
    """(key, encoded feature, value, contribution) rows — the long table itself."""
    return contrib


def explain_bundle(model: PipelineModel, task: Task, rows: DataFrame, background: DataFrame, key: str,
                   top_k: int = 5) -> dict[str, DataFrame]:
    """Linear attribution when the final stage is linear, else coalition Shapley values."""
    try:
        contrib = linear_contributions(model, task, rows, background, key)
        kind = "linear"
    except TypeError:
        sv = shapley_values(model, task, rows, background, key)
        contrib = sv.select(key, F.col("feature").alias("encoded"), F.col("feature").alias("source"),
                            F.lit(None).cast("double").alias("value"), F.col("shap_value").alias("contribution"), "magnitude")
        kind = "coalition"
    return {"kind": kind, "contributions": contrib, "global": global_importance(contrib),
            "local": local_explanation(contrib, rows.select(key, *task.inputs), key, top_k)}


__all__ = ["linear_contributions", "shapley_values", "global_importance", "local_explanation",
           "permutation_importance", "beeswarm", "explain_bundle"]
