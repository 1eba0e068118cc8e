"""Composed runs: raw table → trained, audited, explained and registered model → scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.domain import SCORE_LIMITS, SENSITIVE_ATTRIBUTES
from cohortlens.operators import attribution, fairness, metrics
from cohortlens.operators.clean import clean, normalise_columns
from cohortlens.operators.features import Task, engineer
from cohortlens.operators.modeling import LABEL_COL
from cohortlens.operators.scoring import score
from cohortlens.operators.split import fixed_sample, train_test_split
from cohortlens.operators.training import KEY, TrainConfig, TrainResult, prepare, train_task
from cohortlens.operators.validate import assert_valid
from cohortlens.sources.registry import ModelRegistry, fingerprint

#: rows of the training table that attribution takes as background
BACKGROUND_ROWS = 50


def load_clean(raw: DataFrame, require_scores: bool = True) -> DataFrame:
    """Declared column names, clean strings, no repeated rows, validated."""
    return assert_valid(clean(normalise_columns(raw)), require_scores=require_scores)


def load_engineered(raw: DataFrame) -> DataFrame:
    """S3: the engineered view of a raw table."""
    return engineer(load_clean(raw))


@dataclass
class Outcome:
    """One finished run: its version in the registry, hold-out metrics and the tables behind them."""

    version: str
    trained: TrainResult
    holdout: dict[str, float]
    audit: dict
    explanation: dict


def holdout_metrics(task: Task, scored: DataFrame, threshold: float | None, q: float | None, alpha: float) -> dict[str, float]:
    """Metrics of rows the model has not seen, as a small mapping."""
    if task.kind == "binary":
        wide = metrics.binary_metrics(scored, LABEL_COL, "p1", threshold if threshold is not None else 0.5)
    elif task.kind == "multiclass":
        probs = scored.select(LABEL_COL, *[vector_to_array("probability")[i].alias(f"p{i}") for i in range(len(task.levels))])
        wide = metrics.multiclass_metrics(probs, LABEL_COL, [f"p{i}" for i in range(len(task.levels))])
    else:
        wide = metrics.regression_metrics(scored, LABEL_COL, "prediction")
    out = {c: float(v) for c, v in wide.first().asDict().items() if isinstance(v, (int, float))}
    if task.kind == "regression" and q is not None:
        cover = metrics.interval_coverage(scored, LABEL_COL, "prediction", q, alpha).first().asDict()
        out |= {f"interval_{c}": float(v) for c, v in cover.items() if isinstance(v, (int, float))}
    return out


def run_pipeline(spark: SparkSession, engineered: DataFrame, task: Task, registry: ModelRegistry,
                 cfg: TrainConfig | None = None, attributes: Sequence[str] = SENSITIVE_ATTRIBUTES,
                 test_size: float = 0.2, version: str | None = None) -> Outcome:
    """Split → train → hold-out metrics → explain → audit → register → track, for one task."""
    cfg = cfg or TrainConfig()
    split = train_test_split(engineered, KEY, [task.target] if task.levels else [], test_size, cfg.seed).persist()
    train, test = (split.where(F.col("part") == part).drop("part") for part in ("train", "test"))
    res = train_task(task, train, cfg)
    scored = res.model.transform(prepare(task, test))
    if task.kind == "binary":
        scored = scored.withColumn("p1", vector_to_array("probability")[1])
    keep = [a for a in attributes if a not in scored.columns]
    scored = (scored.join(test.select(KEY, *keep), KEY) if keep else scored).persist()
    holdout = holdout_metrics(task, scored, res.threshold, res.conformal_q, cfg.conformal_alpha)
    binary = task.kind == "binary"
    audit = fairness.audit(scored, LABEL_COL, task.kind, list(attributes), score="p1" if binary else None,
                           pred=None if binary else "prediction", threshold=res.threshold if binary else 0.5,
                           group_thresholds=res.group_thresholds, mitigation_attribute=cfg.fairness_attribute)
    explained = attribution.explain_bundle(res.model, task, test.select(KEY, *task.inputs),
                                           fixed_sample(train, KEY, BACKGROUND_ROWS, cfg.seed), KEY)
    tables = {"fairness": audit["groups"], "importance": explained["global"]}
    if res.group_thresholds is not None:
        tables["group_thresholds"] = res.group_thresholds
    sizes = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    details = {"features": list(task.inputs), "kind": task.kind, "n_train": sizes.get("train", 0), "n_test": sizes.get("test", 0),
               "fairness_attribute": cfg.fairness_attribute if res.group_thresholds is not None else None,
               "conformal_alpha": cfg.conformal_alpha, "bounds": list(SCORE_LIMITS), "attribution": explained["kind"]}
    version = registry.save(task.name, res.model, model_name=res.best_candidate, family=res.best_candidate, params=res.best_params,
                            metrics=holdout, leaderboard=res.leaderboard.where("state = 'COMPLETE'"), tuning=res.tuning,
                            threshold=res.threshold, conformal_q=res.conformal_q, cv_score=res.cv_score,
                            fingerprint_value=fingerprint(engineered).first()["fingerprint"], version=version,
                            details=details, tables=tables)
    registry.log_run(f"{task.name}-{version}", task.name, {"model": res.best_candidate, **res.best_params}, {
        **holdout, f"cv_{task.metrics[0]}": res.cv_score})
    scored.unpersist()
    split.unpersist()
    return Outcome(version, res, holdout, audit, explained)


def score_registered(registry: ModelRegistry, task: Task, rows: DataFrame, version: str | None = None) -> DataFrame:
    """Scores of a registered version, with the thresholds, mitigation and interval that were stored with it."""
    model, meta = registry.load(task.name, version)
    d = meta["details"]
    return score(rows, model, task, threshold=meta["threshold"] if meta["threshold"] is not None else 0.5,
                 group_thresholds=registry.table(task.name, "group_thresholds", meta["version"]),
                 attribute=d.get("fairness_attribute"), interval_q=meta["conformal_q"], alpha=d.get("conformal_alpha"),
                 bounds=tuple(d.get("bounds", SCORE_LIMITS)), version=meta["version"])


def run_all(spark: SparkSession, engineered: DataFrame, tasks: Sequence[Task], registry: ModelRegistry,
            cfg: TrainConfig | None = None) -> DataFrame:
    """Every task end to end; one row a task with its model, scores and hold-out metrics."""
    rows = []
    for t in tasks:
        o = run_pipeline(spark, engineered, t, registry, cfg)
        rows.append((t.name, t.kind, o.version, o.trained.best_candidate, float(o.trained.cv_score), o.trained.threshold,
                     o.trained.conformal_q, o.holdout, float(o.trained.train_seconds)))
    return spark.createDataFrame(rows, "task string, kind string, version string, model string, cv_score double, threshold double, "
                                       "conformal_q double, holdout map<string,double>, train_seconds double")
