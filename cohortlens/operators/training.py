"""Cross-validated leaderboard, tuning and full training of a task.

Each (candidate, repeat, fold) fit is an independent Spark job on a cached,
fold-tagged table; fits are submitted from a small driver thread pool.
Out-of-fold predictions of all folds are unioned (J6) and every metric is
computed by the DataFrame metric operators grouped by (repeat, fold), so the
scoring itself is distributed.
"""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.domain import SENSITIVE_ATTRIBUTES
from cohortlens.operators import metrics as M
from cohortlens.operators import thresholds as T
from cohortlens.operators.conformal import conformal_quantile
from cohortlens.operators.features import Task, build_xy
from cohortlens.operators.gram import fold_gram, ridge_oof
from cohortlens.operators.modeling import LABEL_COL, WEIGHT_COL, Candidate, candidates, make_pipeline
from cohortlens.operators.split import kfold

KEY = "student_id"


@dataclass
class TrainConfig:
    seed: int = 42
    cv_folds: int = 5
    cv_repeats: int = 2
    n_trials: int = 40
    target_recall: float = 0.80
    conformal_alpha: float = 0.10
    fairness_attribute: str | None = "lunch"
    parallelism: int = 4
    candidates: Sequence[str] | None = None
    #: of the trials of a search, one in so many goes on after each rung (1: all go on)
    halving: int = 2


@dataclass
class TrainResult:
    task: Task
    model: PipelineModel
    best_candidate: str
    best_params: dict[str, Any]
    leaderboard: DataFrame
    cv_score: float
    threshold: float | None = None
    group_thresholds: DataFrame | None = None
    conformal_q: float | None = None
    tuning: DataFrame | None = None
    train_seconds: float = 0.0
    extras: dict[str, Any] = field(default_factory=dict)


def metric_names(task: Task) -> list[str]:
    return list(task.metrics)


def n_classes(task: Task) -> int:
    return max(2, len(task.levels))


def prepare(task: Task, engineered: DataFrame, key: str = KEY) -> DataFrame:
    """Features + label (+ balanced class weights for classification, A20)."""
    xy = build_xy(task, engineered, LABEL_COL, keep=[key] + [a for a in SENSITIVE_ATTRIBUTES
                                                          if a not in task.inputs])
    if not task.levels:
        return xy.withColumn(WEIGHT_COL, F.lit(1.0))
    counts = xy.groupBy(LABEL_COL).agg(F.count(F.lit(1)).alias("__nc"))
    n = xy.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    # one row per class: a bounded broadcast
    return xy.join(F.broadcast(counts), LABEL_COL).withColumn(
        WEIGHT_COL, n / (k * F.col("__nc"))).drop("__nc")


def _scored(task: Task, pred: DataFrame) -> DataFrame:
    """Add ``p1`` (binary), ``probs`` (multiclass) columns from MLlib outputs."""
    if task.kind == "binary":
        return pred.withColumn("p1", vector_to_array("probability")[1])
    if task.kind == "multiclass":
        return pred.withColumn("probs", vector_to_array("probability"))
    return pred


def fold_metrics(task: Task, oof: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of out-of-fold predictions per ``keys`` → long (keys, metric, value)."""
    k = list(keys)
    if task.kind == "binary":
        b = M.binary_metrics(oof, LABEL_COL, "p1", 0.5, k)
        wide = b.select(*k, "roc_auc", "average_precision", "f1", "recall", "precision", "balanced_accuracy")
    elif task.kind == "regression":
        r = M.regression_metrics(oof, LABEL_COL, "prediction", k)
        wide = r.select(*k, "r2", (-F.col("rmse")).alias("neg_root_mean_squared_error"),
                        (-F.col("mae")).alias("neg_mean_absolute_error"))
    else:
        mc = M.multiclass_metrics(
            oof.select(*k, LABEL_COL, *[vector_to_array("probability")[i].alias(f"__p{i}")
                                        for i in range(n_classes(task))]),
            LABEL_COL, [f"__p{i}" for i in range(n_classes(task))], k)
        wide = mc.select(*k, "f1_macro", "accuracy", "balanced_accuracy")
    return M.long_metrics(wide, k)


def cross_validate(task: Task, folds: DataFrame, cand: Candidate, params: dict[str, Any],
                   cfg: TrainConfig, ctx: dict[str, Any], only: Sequence[int] | None = None) -> tuple[DataFrame, float]:
    """Fit on K-1 folds, predict the held-out fold, for every (repeat, fold) or the folds in ``only``; returns OOF rows and seconds a fit."""
    if cand.name == "ridge":
        return _ridge_folds(task, folds, params, ctx, only)
    return refit_folds(task, folds, cand, params, cfg, ctx, only)


def _ridge_folds(task: Task, folds: DataFrame, params: dict[str, Any], ctx: dict[str, Any], only: Sequence[int] | None = None) -> tuple[DataFrame, float]:
    """All folds from one scan; a search scans once for all its trials (``ctx`` keeps the statistics)."""
    t0 = time.perf_counter()
    with ctx.setdefault("lock", threading.Lock()):
        if ctx.get("gram_of") is not folds:
            ctx["gram"], ctx["gram_of"] = fold_gram(folds, list(task.inputs), LABEL_COL), folds
    gram = ctx["gram"]
    held = folds if only is None else folds.where(F.col("fold").isin(list(only)))
    oof = ridge_oof(gram, held, params, ctx).select("repeat", "fold", KEY, LABEL_COL, "prediction")
    return oof, (time.perf_counter() - t0) / len(gram.held_out)


def refit_folds(task: Task, folds: DataFrame, cand: Candidate, params: dict[str, Any],
                cfg: TrainConfig, ctx: dict[str, Any], only: Sequence[int] | None = None) -> tuple[DataFrame, float]:
    """One fit for each (repeat, fold), submitted from a small thread pool."""
    pairs = [(r.repeat, r.fold) for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()
             if only is None or r.fold in only]
    feats = list(task.inputs)

    def one(rf):
        rep, fold = rf
        part = folds.where(F.col("repeat") == rep)
        train = part.where(F.col("fold") != fold)
        t0 = time.perf_counter()
        model = make_pipeline(train, feats, cand, params, ctx).fit(train)
        secs = time.perf_counter() - t0
        pred = model.transform(part.where(F.col("fold") == fold))
        return _scored(task, pred), secs

    with ThreadPoolExecutor(max_workers=max(1, cfg.parallelism)) as ex:
        outs = list(ex.map(one, pairs))
    keep = ["repeat", "fold", KEY, LABEL_COL, "prediction"] + (
        ["probability"] if task.levels else []) + (["p1"] if task.kind == "binary" else [])
    oof = outs[0][0].select(*keep)
    for o, _ in outs[1:]:
        oof = oof.unionByName(o.select(*keep))  # J6: keys carried, no join
    return oof, sum(s for _, s in outs) / len(outs)


def _ctx(task: Task, data: DataFrame, seed: int) -> dict[str, Any]:
    st = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL_COL).alias("s")).first()
    return {"n": float(st["n"]), "y_std": float(st["s"] or 1.0), "seed": seed}


def leaderboard(task: Task, data: DataFrame, cfg: TrainConfig) -> tuple[DataFrame, dict[str, float]]:
    """CV every candidate of the task's kind; mean ± pop-std per metric, fit seconds, rank.

    A candidate that fails is skipped. Returns the board and the primary CV score per candidate.
    """
    spark = data.sparkSession
    strata = [LABEL_COL] if task.levels else []
    folds = kfold(data, KEY, cfg.cv_folds, strata, cfg.cv_repeats, cfg.seed).persist()
    folds.count()  # fill the cache once before concurrent fits read it
    ctx = _ctx(task, data, cfg.seed)
    cands = [c for c in candidates(task.kind, n_classes(task)) if not cfg.candidates or c.name in cfg.candidates]

    def one(cand: Candidate) -> dict[str, Any]:
        t0 = time.perf_counter()
        row: dict[str, Any] = {"model": cand.name, "family": cand.family, "state": "COMPLETE"}
        try:
            oof, fit_s = cross_validate(task, folds, cand, {}, cfg, ctx)
            fm = fold_metrics(task, oof, ["repeat", "fold"])
            summ = fm.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()
        except Exception as exc:  # noqa: BLE001 - a failing candidate is a row of the board, never its winner
            return row | {"state": "FAIL", "error": str(exc), "elapsed_seconds": time.perf_counter() - t0}
        for r in summ:  # one row per metric
            row[f"{r.metric}_mean"] = float(r["mean"]) if r["mean"] is not None else None
            row[f"{r.metric}_std"] = float(r["std"]) if r["std"] is not None else None
        row["fit_seconds"] = fit_s
        row["elapsed_seconds"] = time.perf_counter() - t0
        return row

    # candidates are independent: their CV jobs are submitted concurrently
    with ThreadPoolExecutor(max_workers=max(1, min(cfg.parallelism, len(cands) or 1))) as ex:
        rows = list(ex.map(one, cands))
    score = f"{task.metrics[0]}_mean"
    primary = {r["model"]: r[score] if r.get(score) is not None else float("-inf")
               for r in rows if r["state"] == "COMPLETE"}
    folds.unpersist()
    cols = ["model", "family"] + [f"{m}_{s}" for m in metric_names(task) for s in ("mean", "std")] + [
        "fit_seconds", "elapsed_seconds", "state", "error"]
    board = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows],
                                  ", ".join(f"`{c}` {'string' if c in ('model', 'family', 'state', 'error') else 'double'}"
                                            for c in cols))
    from cohortlens.operators.split import rank_by_metric
    board = rank_by_metric(board, f"{task.metrics[0]}_mean").withColumn("task", F.lit(task.name))
    return board, primary


def rungs_of(folds: int) -> list[range]:
    """The folds that each rung adds: one, then as many as there were, up to all."""
    out, upto = [], 0
    while upto < folds:
        nxt = min(folds, max(1, 2 * upto))
        out.append(range(upto, nxt))
        upto = nxt
    return out


def tune(task: Task, data: DataFrame, cand: Candidate, cfg: TrainConfig) -> tuple[dict[str, Any], float, DataFrame]:
    """Seeded random search with successive halving; trial table (number, value, state, params, duration).

    All trials run on the first fold; the better ones go on to more folds, the others are PRUNED (without a value: theirs would be of
    fewer folds). The value of a COMPLETE trial is the mean of the primary metric over all folds of one repeat. Which trials go on
    depends on scores and numbers alone, not on their order of arrival. A candidate without a space is not tuned.
    """
    spark = data.sparkSession
    schema = "number int, value double, state string, params string, duration double"
    if cand.space is None or cfg.n_trials <= 0:
        return {}, float("nan"), spark.createDataFrame([], schema)
    rng = random.Random(cfg.seed)
    strata = [LABEL_COL] if task.levels else []
    folds = kfold(data, KEY, cfg.cv_folds, strata, 1, cfg.seed).persist()
    folds.count()  # fill the cache once before concurrent trials read it
    ctx = _ctx(task, data, cfg.seed)
    # every trial's parameters are drawn up front (same order
    # as a sequential search), so trials are independent and run concurrently
    drawn = [cand.space(rng) for _ in range(cfg.n_trials)]
    scores: list[list[float]] = [[] for _ in drawn]
    state = ["PRUNED"] * len(drawn)
    seconds = [0.0] * len(drawn)

    def one(i: int, only: range) -> None:
        t0 = time.perf_counter()
        try:
            oof, _ = cross_validate(task, folds, cand, drawn[i], cfg, ctx, only)
            rows = fold_metrics(task, oof, ["repeat", "fold"]).where(F.col("metric") == task.metrics[0]).select("value").collect()
            scores[i] += [r["value"] for r in rows]  # one row a fold
            if any(v is None for v in scores[i]):
                raise ValueError("a fold has no score")
        except Exception as exc:  # noqa: BLE001 - a failing trial is a row of the table
            state[i] = f"FAIL: {exc}"
        seconds[i] += time.perf_counter() - t0

    mean = lambda i: sum(scores[i]) / len(scores[i])
    alive = list(range(cfg.n_trials))
    rungs = rungs_of(cfg.cv_folds)
    for at, added in enumerate(rungs):
        with ThreadPoolExecutor(max_workers=max(1, cfg.parallelism)) as ex:
            list(ex.map(lambda i: one(i, added), alive))
        alive = sorted((i for i in alive if state[i] == "PRUNED"), key=lambda i: (-mean(i), i))
        if at + 1 < len(rungs):
            alive = alive[: -(-len(alive) // cfg.halving)]
    for i in alive:
        state[i] = "COMPLETE"
    best, best_params = float("-inf"), {}
    if alive:
        best, best_params = mean(alive[0]), drawn[alive[0]]  # of equal ones the first
    folds.unpersist()
    trials = [(i, mean(i) if state[i] == "COMPLETE" else None, state[i], json.dumps(p, sort_keys=True), seconds[i]) for i, p in enumerate(drawn)]
    return best_params, best, spark.createDataFrame(trials, schema)


def best_so_far(trials: DataFrame) -> DataFrame:
    """Running max of trial values (nulls dropped first). Trial tables are small."""
    from pyspark.sql import Window
    w = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return trials.where(F.col("value").isNotNull()).withColumn("best_so_far", F.max("value").over(w))


def train_task(task: Task, train: DataFrame, cfg: TrainConfig | None = None) -> TrainResult:
    """Leaderboard → tune the best non-baseline (F2) → OOF threshold and group thresholds
    (binary) or cross-conformal half-width (regression, Q2) → final fit on all training rows."""
    cfg = cfg or TrainConfig()
    t_start = time.perf_counter()
    data = prepare(task, train).persist()
    board, primary = leaderboard(task, data, cfg)
    zoo = {c.name: c for c in candidates(task.kind, n_classes(task))}
    ranked = sorted(((v, k) for k, v in primary.items() if zoo[k].family != "dummy"), reverse=True)
    best_name = ranked[0][1] if ranked else "baseline"
    cand = zoo[best_name]
    cv_score = primary.get(best_name, float("nan"))
    params, tuned_score, trials = tune(task, data, cand, cfg)
    if not (tuned_score == tuned_score and tuned_score >= cv_score):
        params = {}
    else:
        cv_score = tuned_score
    ctx = _ctx(task, data, cfg.seed)
    res = TrainResult(task, None, best_name, params, board, cv_score, tuning=trials)  # type: ignore[arg-type]
    if task.kind in ("binary", "regression"):
        strata = [LABEL_COL] if task.levels else []
        folds = kfold(data, KEY, cfg.cv_folds, strata, 1, cfg.seed).persist()
        oof, _ = cross_validate(task, folds, cand, params, cfg, ctx)
        if task.kind == "binary":
            thr = T.threshold_at_recall(oof, LABEL_COL, "p1", cfg.target_recall)
            res.threshold = float(thr.first()["threshold"])
            attr = cfg.fairness_attribute
            if attr and attr in data.columns:
                with_attr = oof.join(data.select(KEY, attr), KEY)
                res.group_thresholds = T.group_thresholds(
                    with_attr, LABEL_COL, "p1", attr, cfg.target_recall, res.threshold)
        else:
            resid = oof.select((F.col(LABEL_COL) - F.col("prediction")).alias("r"))
            q = conformal_quantile(resid, "r", cfg.conformal_alpha).first()
            if q is None:
                raise ValueError("Cannot calibrate on zero residuals")
            res.conformal_q = float(q["quantile"])
        folds.unpersist()
    res.model = make_pipeline(data, list(task.inputs), cand, params, ctx).fit(data)
    data.unpersist()
    res.train_seconds = time.perf_counter() - t_start
    return res


def run_all(spark: SparkSession, engineered: DataFrame, tasks: Sequence[Task],
            cfg: TrainConfig | None = None) -> dict[str, TrainResult]:
    """Train every task on the same engineered table."""
    return {t.name: train_task(t, engineered, cfg) for t in tasks}


def summary_rows(spark: SparkSession, results: dict[str, TrainResult]) -> DataFrame:
    """One row per task with its scalar outcomes (driver-sized: one row per task)."""
    rows = [(name, r.task.kind, r.best_candidate, float(r.cv_score), r.threshold, r.conformal_q,
             float(r.train_seconds)) for name, r in results.items()]
    return spark.createDataFrame(rows, "task string, kind string, model string, cv_score double, "
                                       "threshold double, conformal_q double, train_seconds double")
