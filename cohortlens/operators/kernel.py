"""Nyström features for an RBF kernel (L12), for every kind of task.

``m`` landmarks are drawn from the distinct training vectors (least seeded hashes: one top-m aggregation, the same on every
partitioning). With the kernel matrix K of the landmarks, a row x is mapped to k(x, landmarks) K^(-1/2), whose inner products equal the
kernel on the landmarks and approximate it elsewhere (Williams & Seeger, 2001); a linear model on this map is the kernel machine. Only the landmarks
(m x width, a parameter) reach the driver. The map is one vectorised pandas UDF.

The logistic fit holds m numbers a row for its iterations. Its loss depends on a row only through vector, label and weight, so rows are first
collapsed to distinct (vector, label) with the sum of their weights: the same loss, over as many rows as there are different ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage, release

#: rows up to which the logistic fit takes them one by one, and distinct ones in a partition
ROWS = 1 << 16
PART_ROWS = 20_000


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - y|^2) between the rows of ``x`` and of ``y``."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T
    return np.exp(-gamma * np.maximum(d, 0.0))


def inverse_root(k: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """K^(-1/2) on the directions whose eigenvalue exceeds ``least`` times the largest: (m, directions)."""
    value, vector = np.linalg.eigh(k)
    keep = value > least * max(float(value[-1]), 1e-300)
    return vector[:, keep] / np.sqrt(value[keep])


class NystromModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted map of ``inputCol`` to ``outputCol``."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    state = Param(Params._dummy(), "state", "landmarks and the inverse root of their kernel as JSON", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "input vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output vector", TypeConverters.toString)

    def __init__(self, gamma: float = 1.0, state: str = '{"landmarks": [], "root": []}', inputCol: str = "features", outputCol: str = "kernel"):
        super().__init__()
        self._set(gamma=gamma, state=state, inputCol=inputCol, outputCol=outputCol)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        s = json.loads(self.getOrDefault(self.state))
        return np.asarray(s["landmarks"], float), np.asarray(s["root"], float)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma = self.getOrDefault(self.gamma)
        landmarks, root = self.arrays()

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(list(rbf(np.vstack(x.to_numpy()), landmarks, gamma) @ root) if len(x) else [], dtype=object)

        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(mapped(vector_to_array(self.getOrDefault(self.inputCol)))))


class NystromEstimator(Estimator):
    """``gamma=None`` takes 1 / (width x variance of all encoded values)."""

    def __init__(self, n_components: int = 200, gamma: float | None = None, seed: int = 0, inputCol: str = "features", outputCol: str = "kernel"):
        super().__init__()
        self.n_components, self.gamma, self.seed, self.cols = n_components, gamma, seed, (inputCol, outputCol)

    def _fit(self, df: DataFrame) -> NystromModel:
        rows = df.select(vector_to_array(self.cols[0]).alias("x"))
        gamma = self.gamma
        if gamma is None:
            total = lambda f: F.sum(F.aggregate("x", F.lit(0.0), f))
            s = rows.agg(F.sum(F.size("x")).alias("n"), F.max(F.size("x")).alias("width"), total(lambda a, v: a + v).alias("s"),
                         total(lambda a, v: a + v * v).alias("q")).first()
            var = s["q"] / s["n"] - (s["s"] / s["n"]) ** 2 if s["n"] else 0.0
            gamma = 1.0 / (s["width"] * var) if var > 1e-12 else 1.0
        drawn = rows.distinct().orderBy(F.xxhash64("x", F.lit(self.seed)), "x").limit(self.n_components).collect()
        if not drawn:
            raise ValueError("a kernel map needs at least one row")
        landmarks = np.asarray([r["x"] for r in drawn], float)
        root = inverse_root(rbf(landmarks, landmarks, gamma))
        return NystromModel(float(gamma), json.dumps({"landmarks": landmarks.tolist(), "root": root.tolist()}), *self.cols)


class KernelLogistic(Estimator):
    """The map of ``features``, then the logistic fit ``last`` on its output over distinct rows."""

    def __init__(self, features: NystromEstimator, last: LogisticRegression):
        super().__init__()
        self.features, self.last = features, last

    def _fit(self, df: DataFrame) -> PipelineModel:
        mapped = self.features.fit(df)
        if df.limit(ROWS + 1).count() <= ROWS:
            return PipelineModel([mapped, self.last.fit(mapped.transform(df))])
        vector, label, weight = self.features.cols[0], self.last.getLabelCol(), self.last.getWeightCol()
        counted = (df.select(vector_to_array(vector).alias("x"), label, weight).groupBy("x", label).agg(F.sum(weight).alias(weight)))
        table = cut_lineage(counted)
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-table.count() // PART_ROWS))
        rows = table.repartition(parts).select(array_to_vector("x").alias(vector), label, weight)
        model = self.last.fit(mapped.transform(rows))
        release(table)
        return PipelineModel([mapped, model])
