"""Preprocessing and the candidate zoo on MLlib.

A candidate is a name, a family and a factory ``build(params) -> Estimator``.
Preprocessing is part of every ``PipelineModel`` so a persisted model accepts
raw rows: nominal columns → ``StringIndexer(keep)`` + ``OneHotEncoder``
(unknown → all zeros), the ordered category → its rank (unknown → -1), numeric
columns → ``(x - mean) / std_pop`` with training statistics inlined by a
``SQLTransformer`` (MLlib's ``StandardScaler`` uses ddof 1).
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.domain import PARENTAL_EDUCATION
from cohortlens.operators.boosting import HistBoostingEstimator
from cohortlens.operators.forest import ForestEstimator
from cohortlens.operators.kernel import KernelLogistic, NystromEstimator
from cohortlens.operators.neighbours import KNNEstimator

NOMINAL = ("gender", "race_ethnicity", "lunch", "test_preparation_course")
ORDINAL = {"parental_level_of_education": PARENTAL_EDUCATION}
FEATURES_COL = "features"
LABEL_COL = "label"
WEIGHT_COL = "weight"


def _q(v: str) -> str:
    return "'" + v.replace("'", "\\'") + "'"


@dataclass
class Encoding:
    """Encoded column layout, for attribution."""

    encoded: list[str]
    source: list[str]


def preprocess_stages(train: DataFrame, features: Sequence[str], scale_numeric: bool = True
                      ) -> tuple[list[Transformer | Estimator], list[str]]:
    """L4: stages producing ``features`` from raw columns; returns (stages, assembler inputs)."""
    nominal = [c for c in features if c in NOMINAL]
    ordinal = [c for c in features if c in ORDINAL]
    numeric = [c for c in features if c not in nominal and c not in ordinal]
    stages: list[Any] = []
    exprs = []
    for c in ordinal:
        arr = "array(" + ", ".join(_q(v) for v in ORDINAL[c]) + ")"
        exprs.append(f"CAST(array_position({arr}, `{c}`) - 1 AS DOUBLE) AS `__ord_{c}`")
    if numeric and scale_numeric:
        # training mean and population std: 2 numbers per column, inlined as literals
        st = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                         for c in numeric]).first()
        for c in numeric:
            m, s = st[c]["m"] or 0.0, st[c]["s"] or 0.0
            s = s if s and s > 0 else 1.0
            exprs.append(f"(CAST(`{c}` AS DOUBLE) - {m!r}) / {s!r} AS `__num_{c}`")
    elif numeric:
        exprs += [f"CAST(`{c}` AS DOUBLE) AS `__num_{c}`" for c in numeric]
    if exprs:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__"))
    if nominal:
        stages.append(StringIndexer(inputCols=nominal, outputCols=[f"__idx_{c}" for c in nominal],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"__idx_{c}" for c in nominal],
                                    outputCols=[f"__ohe_{c}" for c in nominal], dropLast=True))
        # the indexer sends unknown values to the extra last index, which dropLast
        # removes: an unknown category encodes as all zeros
    inputs = [f"__ohe_{c}" for c in nominal] + [f"__ord_{c}" for c in ordinal] + [f"__num_{c}" for c in numeric]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES_COL, handleInvalid="keep"))
    return stages, inputs


def encoding_of(model: PipelineModel, features: Sequence[str]) -> Encoding:
    """Encoded column names and their source feature, from the fitted stages."""
    labels: dict[str, list[str]] = {}
    for st in model.stages:
        if st.__class__.__name__ == "StringIndexerModel":
            for c, ls in zip(st.getInputCols(), st.labelsArray):
                labels[c] = list(ls)
    enc, src = [], []
    for c in [c for c in features if c in NOMINAL]:
        for lab in labels.get(c, []):
            enc.append(f"{c}_{lab}")
            src.append(c)
    for c in [c for c in features if c in ORDINAL]:
        enc.append(c)
        src.append(c)
    for c in [c for c in features if c not in NOMINAL and c not in ORDINAL]:
        enc.append(c)
        src.append(c)
    return Encoding(enc, src)


# --------------------------------------------------------------------------- candidates

class ConstantModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """L6 baseline: class priors (classification) or the mean (regression) as literal columns."""

    kind = Param(Params._dummy(), "kind", "task kind", TypeConverters.toString)
    values = Param(Params._dummy(), "values", "priors or mean", TypeConverters.toListFloat)

    def __init__(self, kind: str = "binary", values: list[float] | None = None):
        super().__init__()
        self._set(kind=kind, values=list(values or [0.0]))

    def _transform(self, df: DataFrame) -> DataFrame:
        kind, vals = self.getOrDefault(self.kind), self.getOrDefault(self.values)
        if kind == "regression":
            return df.withColumn("prediction", F.lit(float(vals[0])))
        from pyspark.ml.functions import array_to_vector
        probs = F.array(*[F.lit(float(v)) for v in vals])
        best = max(range(len(vals)), key=lambda i: vals[i])
        return df.withColumns({"probability": array_to_vector(probs), "prediction": F.lit(float(best))})


class ConstantEstimator(Estimator):
    def __init__(self, kind: str, n_classes: int = 2):
        super().__init__()
        self.kind_, self.n_classes = kind, n_classes

    def _fit(self, df: DataFrame) -> ConstantModel:
        if self.kind_ == "regression":
            return ConstantModel(self.kind_, [df.select(F.avg(LABEL_COL)).first()[0] or 0.0])
        counts = dict(df.groupBy(LABEL_COL).count().collect())  # one row per class
        n = sum(counts.values()) or 1
        return ConstantModel(self.kind_, [counts.get(float(i), 0) / n for i in range(self.n_classes)])


@dataclass
class Candidate:
    name: str
    family: str
    build: Callable[[dict[str, Any], dict[str, Any]], list[Any]]
    space: Callable[[random.Random], dict[str, Any]] | None = None
    needs_weights: bool = False


def _lr(kind: str, n_classes: int):
    def build(p, ctx):
        c = float(p.get("C", 1.0))
        return [LogisticRegression(featuresCol=FEATURES_COL, labelCol=LABEL_COL, weightCol=WEIGHT_COL,
                                   regParam=1.0 / (c * ctx["n"]), elasticNetParam=0.0, standardization=False,
                                   maxIter=int(p.get("maxIter", 100)),
                                   family="multinomial" if n_classes > 2 else "binomial")]
    return build


def _ridge(p, ctx):
    alpha = float(p.get("alpha", 1.0))
    return [LinearRegression(featuresCol=FEATURES_COL, labelCol=LABEL_COL,
                             regParam=alpha / ctx["n"] * ctx["y_std"], elasticNetParam=0.0,
                             standardization=False, solver="normal")]


def _rf(kind: str, n_classes: int):
    """300 trees; all features a split for regression. Depth 12 bounds the nodes that the driver holds."""
    def build(p, ctx):
        how = dict(numTrees=int(p.get("numTrees", 300)), maxDepth=int(p.get("maxDepth", 12)),
                   minInstancesPerNode=int(p.get("minInstancesPerNode", 1)),
                   featureSubsetStrategy=str(p.get("featureSubsetStrategy", "all" if kind == "regression" else "sqrt")), seed=ctx["seed"])
        if kind == "regression":
            return [RandomForestRegressor(featuresCol=FEATURES_COL, labelCol=LABEL_COL, **how)]
        return [ForestEstimator(n_classes, featuresCol=FEATURES_COL, labelCol=LABEL_COL, weightCol=WEIGHT_COL, **how)]
    return build


def _hist(kind: str, n_classes: int, **defaults):
    def build(p, ctx):
        return [HistBoostingEstimator(kind, n_classes, FEATURES_COL, LABEL_COL, None if kind == "regression" else WEIGHT_COL, **(defaults | p))]
    return build


def _gbt(kind: str, n_classes: int):
    """100 trees of depth 3. Three classes: MLlib's trees know two only, so trees of eight leaves with multinomial loss."""
    if n_classes > 2:
        eight = _hist(kind, n_classes, max_leaf_nodes=8, min_samples_leaf=1)
        return lambda p, ctx: eight({name: p[old] for old, name in (("maxIter", "max_iter"), ("stepSize", "learning_rate"),
                                                                    ("minInstancesPerNode", "min_samples_leaf")) if old in p}
                                    | ({"max_leaf_nodes": 2 ** int(p["maxDepth"])} if "maxDepth" in p else {}), ctx)

    def build(p, ctx):
        kw = dict(featuresCol=FEATURES_COL, labelCol=LABEL_COL, maxIter=int(p.get("maxIter", 100)),
                  maxDepth=int(p.get("maxDepth", 3)), stepSize=float(p.get("stepSize", 0.1)),
                  subsamplingRate=float(p.get("subsamplingRate", 1.0)), minInstancesPerNode=int(p.get("minInstancesPerNode", 1)), seed=ctx["seed"])
        return [GBTRegressor(**kw)] if kind == "regression" else [GBTClassifier(weightCol=WEIGHT_COL, **kw)]
    return build


def _kernel(kind: str, n_classes: int):
    """RBF kernel machine on Nyström features: ridge or (multinomial) logistic loss, strength C as in the linear models."""
    def build(p, ctx):
        gamma = p.get("gamma")
        features = NystromEstimator(int(p.get("n_components", 200)), None if gamma is None else float(gamma), ctx["seed"], FEATURES_COL, "kernel")
        reg = 1.0 / (float(p.get("C", 1.0)) * ctx["n"])
        if kind == "regression":
            return [features, LinearRegression(featuresCol="kernel", labelCol=LABEL_COL, regParam=reg * ctx["y_std"], elasticNetParam=0.0,
                                               standardization=False)]
        return [KernelLogistic(features, LogisticRegression(featuresCol="kernel", labelCol=LABEL_COL, weightCol=WEIGHT_COL, regParam=reg, elasticNetParam=0.0,
                                                            standardization=False, family="multinomial" if n_classes > 2 else "binomial"))]
    return build


def _knn(kind: str, n_classes: int):
    def build(p, ctx):
        return [KNNEstimator(int(p.get("k", 5)), kind, n_classes, str(p.get("weights", "uniform")), FEATURES_COL, LABEL_COL)]
    return build


def _baseline(kind: str, n_classes: int):
    def build(p, ctx):
        return [ConstantEstimator(kind, n_classes)]
    return build


def _log_uniform(rng: random.Random, lo: float, hi: float) -> float:
    return math.exp(rng.uniform(math.log(lo), math.log(hi)))


def _forest_space(r: random.Random) -> dict[str, Any]:
    return {"numTrees": r.randrange(100, 601, 50), "maxDepth": r.randint(3, 20), "minInstancesPerNode": r.randint(1, 20),
            "featureSubsetStrategy": r.choice(["sqrt", "log2", "all"])}


def _boosting_space(r: random.Random) -> dict[str, Any]:
    return {"maxIter": r.randrange(50, 501, 25), "stepSize": _log_uniform(r, 0.01, 0.3), "maxDepth": r.randint(2, 8),
            "subsamplingRate": r.uniform(0.5, 1.0), "minInstancesPerNode": r.randint(1, 30)}


def _hist_space(r: random.Random) -> dict[str, Any]:
    return {"learning_rate": _log_uniform(r, 0.01, 0.3), "max_iter": r.randrange(50, 501, 25), "max_leaf_nodes": r.randint(4, 64),
            "min_samples_leaf": r.randint(5, 60), "l2_regularization": _log_uniform(r, 1e-4, 10.0)}


def _kernel_space(r: random.Random) -> dict[str, Any]:
    return {"C": _log_uniform(r, 1e-2, 1e2), "gamma": _log_uniform(r, 1e-4, 1.0)}


def _knn_space(r: random.Random) -> dict[str, Any]:
    return {"k": r.randint(3, 60), "weights": r.choice(["uniform", "distance"])}


def candidates(kind: str, n_classes: int = 2) -> list[Candidate]:
    """L6-L12 per task kind, with the spaces that tuning draws from."""
    regression = kind == "regression"
    linear = (Candidate("ridge", "linear", _ridge, lambda r: {"alpha": _log_uniform(r, 1e-3, 1e2)}) if regression else
              Candidate("logistic_regression", "linear", _lr(kind, n_classes), lambda r: {"C": _log_uniform(r, 1e-3, 1e2)}, needs_weights=True))
    weighted = not regression
    return [
        Candidate("baseline", "dummy", _baseline(kind, n_classes)),
        linear,
        Candidate("random_forest", "forest", _rf(kind, n_classes), _forest_space, weighted),
        Candidate("gradient_boosting", "boosting", _gbt(kind, n_classes), _boosting_space, weighted),
        Candidate("hist_gradient_boosting", "hist_boosting", _hist(kind, n_classes), _hist_space, weighted),
        Candidate("svr_rbf" if regression else "svm_rbf", "kernel", _kernel(kind, n_classes), _kernel_space, weighted),
        Candidate("knn", "neighbors", _knn(kind, n_classes), _knn_space),
    ]


def make_pipeline(train: DataFrame, features: Sequence[str], cand: Candidate, params: dict[str, Any],
                  ctx: dict[str, Any]) -> Pipeline:
    """Preprocess → model in one ``Pipeline``."""
    stages, _ = preprocess_stages(train, features)
    return Pipeline(stages=[*stages, *cand.build(params, ctx)])
