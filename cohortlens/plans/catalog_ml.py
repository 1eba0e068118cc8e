"""Registered queries: splits, windows, training, scoring, attribution, streaming.

Training-based queries have no SQL oracle (the driver records a rows-only
check); their operators are tested against brute force in ``tests/``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.functions.domain import LOG_MAXLEN
from cohortlens.operators import attribution as AT
from cohortlens.operators.conformal import conformal_quantile
from cohortlens.operators import features as X
from cohortlens.operators import scoring as S
from cohortlens.operators import split as SP
from cohortlens.operators import thresholds as T
from cohortlens.operators.modeling import LABEL_COL, candidates, make_pipeline
from cohortlens.operators.ordered import top_k_per_key
from cohortlens.operators.training import KEY, TrainConfig, best_so_far, leaderboard, prepare, tune
from cohortlens.plans.registry import register
from cohortlens.plans.sql_inputs import ENGINEERED, STUDENTS, with_ctes
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources import derived as D
from cohortlens.sources.registry import fingerprint
from cohortlens.sources.tables import read_table
from cohortlens.streaming import prediction_log as PL

ENG = with_ctes(STUDENTS, ENGINEERED)


def _eng(spark, sf_dir):
    return X.engineer(D.students(spark, sf_dir))


#: rows of a partition at least
SPREAD_ROWS = 20_000


def _spread(spark, sf_dir):
    """The engineered rows dealt over all cores: a table of one row group would leave the fits and the row-wise Python steps to one
    task. Tables of a few thousand rows stay as they are."""
    eng = _eng(spark, sf_dir)
    most = 3 * spark.sparkContext.defaultParallelism
    parts = eng.select(KEY).limit(most * SPREAD_ROWS).count() // SPREAD_ROWS
    return eng.repartition(parts, KEY) if parts > 1 else eng


@register("split_sizes", ENG + """
SELECT at_risk, part, CAST(n AS BIGINT) AS n FROM (
  SELECT at_risk, 'test' AS part, CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS n FROM eng GROUP BY at_risk
  UNION ALL
  SELECT at_risk, 'train', count(*) - CAST(round_even(count(*) * 0.2, 0) AS BIGINT) FROM eng GROUP BY at_risk)
WHERE n > 0""")
def split_sizes(spark, sf_dir):
    """L1: stratified 80/20 split sizes per (stratum, part)."""
    s = SP.train_test_split(_eng(spark, sf_dir), KEY, ["at_risk"], 0.2, 42)
    return SP.split_sizes(s, ["at_risk"])


@register("fold_sizes", ENG + """
SELECT CAST(r.range AS INTEGER) AS repeat, s.at_risk, CAST(f.range AS INTEGER) AS fold,
  CAST(s.n // 5 + CASE WHEN f.range < s.n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM (SELECT at_risk, count(*) AS n FROM eng GROUP BY at_risk) s, range(2) r, range(5) f
WHERE s.n // 5 + CASE WHEN f.range < s.n % 5 THEN 1 ELSE 0 END > 0""")
def fold_sizes(spark, sf_dir):
    """L2: repeated stratified 5-fold sizes per (repeat, stratum, fold)."""
    k = SP.kfold(_eng(spark, sf_dir), KEY, 5, ["at_risk"], 2, 42)
    return k.groupBy("repeat", "at_risk", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("latest_n_per_key", """
SELECT event_type, event_id, ts, value, CAST(rn AS INTEGER) AS rank FROM (
  SELECT event_type, event_id, ts, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 100""", floats=["value"])
def latest_n_per_key(spark, sf_dir):
    """The latest 100 events per event type (WindowGroupLimit)."""
    ev = read_table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    return top_k_per_key(ev, ["event_type"], [F.desc("ts"), F.desc("event_id")], 100)


@register("background_sample")
def background_sample(spark, sf_dir):
    """L3: fixed-size pseudo-random sample of 200 students (top-k by seeded hash)."""
    return SP.fixed_sample(_eng(spark, sf_dir), KEY, 200, seed=0)


@register("dataset_fingerprint")
def dataset_fingerprint(spark, sf_dir):
    """Order-independent fingerprint of the student table."""
    return fingerprint(D.students(spark, sf_dir))


# --------------------------------------------------------------------------- models

def _fitted(spark, sf_dir, task_name: str, cand_name: str, where: str = "true", **params) -> PipelineModel:
    task = X.TASKS[task_name]
    # read by several fit passes (row stats, indexers, the estimator): cache for the fit only
    data = prepare(task, _spread(spark, sf_dir).where(where)).persist()
    cand = {c.name: c for c in candidates(task.kind, max(2, len(task.levels)))}[cand_name]
    st = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL_COL).alias("s")).first()
    ctx = {"n": float(st["n"]), "y_std": float(st["s"] or 1.0), "seed": 42}
    model = make_pipeline(data, list(task.inputs), cand, params, ctx).fit(data)
    data.unpersist()
    return model


LIGHT = TrainConfig(cv_folds=3, cv_repeats=1, n_trials=3, parallelism=4,
                    candidates=("baseline", "logistic_regression"))


@register("leaderboard")
def leaderboard_q(spark, sf_dir):
    """L14 + A21 + W5: 3-fold CV leaderboard of the at-risk task (baseline vs logistic)."""
    task = X.TASKS["at_risk"]
    board, _ = leaderboard(task, prepare(task, _spread(spark, sf_dir)), LIGHT)
    return board


@register("tuned_trials")
def tuned_trials(spark, sf_dir):
    """L16 + M22: random search over the logistic C with the best-so-far curve."""
    task = X.TASKS["at_risk"]
    cand = {c.name: c for c in candidates("binary")}["logistic_regression"]
    _, _, trials = tune(task, prepare(task, _spread(spark, sf_dir)), cand, LIGHT)
    return best_so_far(trials)


@register("ridge_trials")
def ridge_trials(spark, sf_dir):
    """L16 + M22 in full: 40 trials over 5 folds with successive halving for the ridge strength, all fits from one scan."""
    task = X.TASKS["math_score"]
    cand = {c.name: c for c in candidates("regression")}["ridge"]
    _, _, trials = tune(task, prepare(task, _spread(spark, sf_dir)), cand, TrainConfig())
    return best_so_far(trials).select("number", "value", "state", "params", "best_so_far")


@register("linear_attribution")
def linear_attribution(spark, sf_dir):
    """E1 + E3 + J8: global importance of a logistic at-risk model (linear Shapley values)."""
    task = X.TASKS["at_risk"]
    eng = _spread(spark, sf_dir)
    model = _fitted(spark, sf_dir, "at_risk", "logistic_regression")
    contrib = AT.linear_contributions(model, task, eng.select(KEY, *task.inputs),
                                      SP.fixed_sample(eng, KEY, 200, 0), KEY)
    return AT.global_importance(contrib)


@register("local_explanations")
def local_explanations(spark, sf_dir):
    """E4 + O2: top-3 signed contributions per student with raw values."""
    task = X.TASKS["at_risk"]
    eng = _spread(spark, sf_dir)
    model = _fitted(spark, sf_dir, "at_risk", "logistic_regression")
    rows = eng.select(KEY, *task.inputs)
    contrib = AT.linear_contributions(model, task, rows, SP.fixed_sample(eng, KEY, 200, 0), KEY)
    return AT.local_explanation(contrib, rows, KEY, 3)


@register("shapley_coalition")
def shapley_coalition(spark, sf_dir):
    """Exact interventional Shapley values of every student for a random forest
    (2^5 coalitions × 200 background rows per student)."""
    task = X.TASKS["at_risk"]
    eng = _spread(spark, sf_dir)
    model = _fitted(spark, sf_dir, "at_risk", "random_forest")
    return AT.shapley_values(model, task, eng.select(KEY, *task.inputs), SP.fixed_sample(eng, KEY, 200, 1), KEY)


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    """E5 + J7: permutation importance (10 repeats) of the logistic at-risk model."""
    task = X.TASKS["at_risk"]
    model = _fitted(spark, sf_dir, "at_risk", "logistic_regression")
    data = prepare(task, _spread(spark, sf_dir))
    return AT.permutation_importance(model, task, data, KEY, n_repeats=10)


@register("scored_records")
def scored_records(spark, sf_dir):
    """At-risk prediction records with risk band and mitigated flag."""
    task = X.TASKS["at_risk"]
    eng = _spread(spark, sf_dir)
    model = _fitted(spark, sf_dir, "at_risk", "logistic_regression")
    scored = model.transform(prepare(task, eng)).withColumn("p1", vector_to_array("probability")[1])
    thr = T.threshold_at_recall(scored, LABEL_COL, "p1", 0.8).select("threshold").first()["threshold"]
    gt = T.group_thresholds(scored, LABEL_COL, "p1", "lunch", 0.8, thr)
    return S.score(eng.select(KEY, *task.inputs), model, task, threshold=thr, group_thresholds=gt,
                   attribute="lunch", version="local")


@register("regression_records")
def regression_records(spark, sf_dir):
    """Clipped math-score predictions with a split-conformal interval: four fifths
    of the rows train, the residuals of the others calibrate."""
    task = X.TASKS["math_score"]
    eng = _spread(spark, sf_dir)
    fifth = f"pmod(xxhash64({KEY}), 5)"
    model = _fitted(spark, sf_dir, "math_score", "ridge", f"{fifth} <> 0")
    held = model.transform(prepare(task, eng.where(f"{fifth} = 0"))).withColumn("residual", F.col(LABEL_COL) - F.col("prediction"))
    q = conformal_quantile(held, "residual", 0.1).first()["quantile"]
    return S.score(eng.select(KEY, *task.inputs), model, task, interval_q=q, alpha=0.1, version="local")


@register("multiclass_records")
def multiclass_records(spark, sf_dir):
    """Performance-level label (argmax) and class → probability map."""
    task = X.TASKS["performance_level"]
    eng = _spread(spark, sf_dir)
    model = _fitted(spark, sf_dir, "performance_level", "logistic_regression")
    return S.score(eng.select(KEY, *task.inputs), model, task, version="local")


# --------------------------------------------------------------------------- streaming

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _event_scorer() -> PipelineModel:
    """A fixed scoring stage for events: logistic of the standardised value."""
    st = SQLTransformer(statement="SELECT *, 1.0 / (1.0 + exp(-(value - 50.0) / 15.0)) AS _score FROM __THIS__")
    return PipelineModel(stages=[st])


@register("stream_scored", f"""
SELECT event_id, value, 1.0 / (1.0 + exp(-(value - 50.0) / 15.0)) AS _score, 'events' AS task
FROM events ORDER BY event_id DESC LIMIT {LOG_MAXLEN}""", floats=["value", "_score"])
def stream_scored(spark, sf_dir):
    """Stream the events table through a scorer into the prediction log
    (availableNow), then read the live window (latest 5,000 rows per task)."""
    # a fresh run folder under the session's (shared) checkpoint directory
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    model = _event_scorer()
    q = PL.start_scoring_stream(spark, sf_dir, EVENT_SCHEMA, model.transform, "events", os.path.join(run, "log"),
                                os.path.join(run, "ckpt"), glob="events.parquet", sequence="event_id")
    q.awaitTermination()
    return PL.window(spark, os.path.join(run, "log")).select("event_id", "value", "_score", "task")


@register("knn_scores")
def knn_scores(spark, sf_dir):
    """Exact 15-NN at-risk probabilities over the prototypes (distinct vectors) of all labelled rows."""
    task = X.TASKS["at_risk"]
    model = _fitted(spark, sf_dir, "at_risk", "knn", k=15)
    out = model.transform(_spread(spark, sf_dir).select(KEY, *task.inputs))
    return out.select(KEY, vector_to_array("probability")[1].alias("probability"), "prediction")


@register("knn_levels")
def knn_levels(spark, sf_dir):
    """Exact 5-NN performance levels; nearly every student has a vector of their own, so cells and bounds do the work."""
    task = X.TASKS["performance_level"]
    model = _fitted(spark, sf_dir, "performance_level", "knn")
    out = model.transform(_spread(spark, sf_dir).select(KEY, *task.inputs))
    return out.select(KEY, vector_to_array("probability").alias("probability"), "prediction")


@register("hist_boosting_scores")
def hist_boosting_scores(spark, sf_dir):
    """Performance levels by histogram boosting with multinomial loss, 100 rounds of up to 31 leaves over all rows."""
    task = X.TASKS["performance_level"]
    model = _fitted(spark, sf_dir, "performance_level", "hist_gradient_boosting")
    out = model.transform(_spread(spark, sf_dir).select(KEY, *task.inputs))
    return out.select(KEY, vector_to_array("probability").alias("probability"), "prediction")


@register("kernel_scores")
def kernel_scores(spark, sf_dir):
    """Performance levels by a multinomial RBF kernel machine on 200 Nyström landmarks."""
    task = X.TASKS["performance_level"]
    model = _fitted(spark, sf_dir, "performance_level", "svm_rbf")
    out = model.transform(_spread(spark, sf_dir).select(KEY, *task.inputs))
    return out.select(KEY, vector_to_array("probability").alias("probability"), "prediction")
