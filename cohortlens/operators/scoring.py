"""Scoring: request checks and prediction records.

The same ``score`` function serves batch tables and ``writeStream``
micro-batches: it is a ``PipelineModel.transform`` plus column expressions,
so it stays in whole-stage code except for the model stages themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import expr as E
from cohortlens.functions.domain import SCORE_COLUMNS
from cohortlens.operators.features import Task
from cohortlens.operators.thresholds import apply_group_thresholds
from cohortlens.operators.validate import assert_valid


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Columns that are null on every row are dropped (one aggregate of non-null counts)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def request_frame(df: DataFrame, features: Sequence[str], *, validate: bool = True) -> DataFrame:
    """P5 + S6 + S7: all-null columns dropped, missing required features listed in the error,
    scores cast to double (raises on bad values under ANSI), other strings trimmed (case kept)."""
    df = drop_all_null_columns(df)
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"Missing required fields: {missing}")
    exprs = {}
    for f in df.schema.fields:
        if f.name in SCORE_COLUMNS:
            exprs[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, T.StringType):
            exprs[f.name] = F.trim(F.col(f.name))
    out = df.withColumns(exprs) if exprs else df
    if validate:
        assert_valid(out, require_scores=False)
    return out


def monitored_score(task: Task, out: DataFrame) -> Column:
    """The one number per prediction whose distribution is monitored."""
    if task.kind == "binary":
        return vector_to_array("probability")[1]
    if task.kind == "regression":
        return E.clip(F.col("prediction"), 0.0, 100.0)
    return F.array_max(vector_to_array("probability"))


def score(df: DataFrame, model: PipelineModel, task: Task, *, threshold: float = 0.5,
          group_thresholds: DataFrame | None = None, attribute: str | None = None,
          interval_q: float | None = None, alpha: float | None = None,
          bounds: tuple[float | None, float | None] = (0.0, 100.0), version: str | None = None) -> DataFrame:
    """Prediction records by task kind, plus ``_score`` (X16) and ``model_version``.

    binary: probability, at_risk (p >= threshold, X13), threshold, risk_band (X8),
    mitigated struct (X14) when group thresholds are given. multiclass: label
    (argmax, X15) and a class → probability map. regression: prediction clipped
    to [0, 100] (X11) and, with a conformal half-width, lower / upper /
    confidence around the clipped point (X12).
    """
    out = model.transform(df)
    keep = list(df.columns)
    if task.kind == "binary":
        p = vector_to_array("probability")[1]
        out = out.withColumn("probability_", p)
        rec = [F.col("probability_").alias("probability"),
               (F.col("probability_") >= F.lit(float(threshold))).alias("at_risk"),
               F.lit(float(threshold)).alias("threshold"),
               E.risk_band("probability_").alias("risk_band")]
        if group_thresholds is not None and attribute and attribute in df.columns:
            out = apply_group_thresholds(out, "probability_", attribute, group_thresholds, threshold)
            rec.append(F.col("mitigated"))
        out = out.select(*keep, *rec, F.col("probability_").alias("_score"))
    elif task.kind == "multiclass":
        probs = vector_to_array("probability")
        classes = F.array(*[F.lit(c) for c in task.levels])
        out = out.select(*keep,
                         F.element_at(classes, F.array_position(probs, F.array_max(probs)).cast("int")).alias("label"),
                         F.map_from_arrays(classes, probs).alias("probabilities"),
                         F.array_max(probs).alias("_score"))
    else:
        point = E.clip(F.col("prediction"), 0.0, 100.0)
        cols = [point.alias("prediction")]
        if interval_q is not None:
            lo, hi = bounds
            lower, upper = point - F.lit(interval_q), point + F.lit(interval_q)
            if lo is not None:
                lower = F.greatest(lower, F.lit(float(lo)))
            if hi is not None:
                upper = F.least(upper, F.lit(float(hi)))
            cols += [lower.alias("lower"), upper.alias("upper")]
            if alpha is not None:
                cols.append(F.lit(1.0 - alpha).alias("confidence"))
        out = out.select(*keep, *cols, point.alias("_score"))
    if version is not None:
        out = out.withColumn("model_version", F.lit(version))
    return out


def reference_scores(model: PipelineModel, task: Task, engineered: DataFrame) -> DataFrame:
    """Model output on the whole engineered table (column ``score``)."""
    out = model.transform(engineered.select(*task.inputs))
    return out.select(monitored_score(task, out).alias("score"))


def drift_for_task(model: PipelineModel, task: Task, reference: DataFrame,
                   current: DataFrame) -> dict[str, DataFrame]:
    """D8 + D9: drift of a supplied current table against the reference population, with
    the model's output distribution (reference scores = the model on the whole reference).
    A supplied table does not touch the prediction log."""
    from cohortlens.operators.drift import drift_report
    cur = request_frame(current, task.inputs, validate=False).select(*task.inputs)
    cur_out = model.transform(cur)
    return drift_report(reference.select(*task.inputs), cur, list(task.inputs),
                        reference_scores=reference_scores(model, task, reference),
                        current_scores=cur_out.select(monitored_score(task, cur_out).alias("score")))
