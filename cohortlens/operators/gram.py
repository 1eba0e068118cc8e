"""Ridge regression of every fold from one scan (L14, L16, L19): sufficient statistics per fold.

A ridge fit needs the rows only through n, the sums and the products of its columns (the Gram matrix). They add up over rows, so
one pass sums them per (repeat, fold) and the training set of a fold is the total of its repeat less the fold itself. All fits of all folds, and of
every strength a search tries, are then solved from these small matrices; the held-out predictions of all folds are one more pass with the
coefficients as a broadcast table of one row a fold. The fits equal those of refitting on the training rows, scaling included.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Key = tuple[int, int]


def _products(width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[Key, np.ndarray] = {}
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            z = np.column_stack([np.ones(len(x)), x, np.asarray(b.column(3), float)])
            repeat, fold = np.asarray(b.column(0)), np.asarray(b.column(1))
            for r, f in set(zip(repeat.tolist(), fold.tolist())):
                part = z[(repeat == r) & (fold == f)]
                total[r, f] = total.get((r, f), 0.0) + part.T @ part
        for (r, f), m in total.items():
            n = m.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r, np.int32)), pa.array(np.full(n, f, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                                              pa.array(m.ravel())], names=["repeat", "fold", "at", "v"])
    return run


@dataclass
class FoldGram:
    """The encoder, and per (repeat, fold) the products of (1, encoded columns, label)."""

    encoder: PipelineModel
    numeric: np.ndarray  # which encoded columns are scaled
    held_out: dict[Key, np.ndarray]

    def training(self, key: Key) -> np.ndarray:
        return sum(m for k, m in self.held_out.items() if k[0] == key[0] and k != key)


def fold_gram(folds: DataFrame, features: Sequence[str], label: str) -> FoldGram:
    """One pass over ``folds(repeat, fold, features, label)``."""
    from cohortlens.operators.modeling import FEATURES_COL, preprocess_stages

    stages, inputs = preprocess_stages(folds, features, scale_numeric=False)
    encoder = Pipeline(stages=stages).fit(folds)
    x = encoder.transform(folds).select(F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold"),
                                        vector_to_array(FEATURES_COL).alias("x"), F.col(label).cast("double").alias("y"))
    names = []
    for st in encoder.stages:
        if st.__class__.__name__ == "StringIndexerModel":
            names += [False] * sum(len(v) for v in st.labelsArray)
    numeric = np.array(names + [i.startswith("__num_") for i in inputs if not i.startswith("__ohe_")], bool)
    width = len(numeric)
    sums = x.mapInArrow(_products(width), "repeat int, fold int, at int, v double").groupBy("repeat", "fold", "at").agg(F.sum("v").alias("v"))
    held: dict[Key, np.ndarray] = {}
    for r in sums.toLocalIterator():  # folds x (columns + 2)^2
        held.setdefault((r["repeat"], r["fold"]), np.zeros((width + 2) ** 2))[r["at"]] = r["v"]
    return FoldGram(encoder, numeric, {k: m.reshape(width + 2, width + 2) for k, m in held.items()})


def ridge(m: np.ndarray, numeric: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of the unscaled columns, from the products ``m`` of the training rows.

    Numeric columns are penalised as if scaled to population deviation 1. ``reg`` is the penalty a row in units of the
    label's deviation, as MLlib's ``regParam``.
    """
    n = m[0, 0]
    mean = m[0, 1:] / n
    c = m[1:, 1:] - n * np.outer(mean, mean)
    var = np.maximum(np.diag(c) / n, 0.0)
    flat = var[:-1] <= 1e-12 * np.maximum(1.0, mean[:-1] ** 2)  # constant in the training rows: scaled by 1
    scale = np.where(numeric & ~flat, var[:-1], 1.0)
    deviation = np.sqrt(var[-1])
    if deviation == 0.0:
        return float(mean[-1]), np.zeros(len(scale))
    beta = np.linalg.pinv(c[:-1, :-1] + np.diag(n * reg / deviation * scale), hermitian=True) @ c[:-1, -1]
    beta[flat & (np.abs(c[:-1, -1]) <= 1e-9 * n)] = 0.0
    return float(mean[-1] - beta @ mean[:-1]), beta


def ridge_oof(gram: FoldGram, folds: DataFrame, params: dict[str, Any], ctx: dict[str, Any]) -> DataFrame:
    """``folds`` with the held-out ``prediction`` of each row, for one strength ``alpha``."""
    from cohortlens.operators.modeling import FEATURES_COL

    reg = float(params.get("alpha", 1.0)) / ctx["n"] * ctx["y_std"]
    fits = [(*key, *ridge(gram.training(key), gram.numeric, reg)) for key in gram.held_out]
    # one row a fold: a bounded broadcast
    coef = folds.sparkSession.createDataFrame([(r, f, b, c.tolist()) for r, f, b, c in fits], "repeat int, fold int, __b double, __c array<double>")
    dot = F.aggregate(F.zip_with(vector_to_array(FEATURES_COL), F.col("__c"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return (gram.encoder.transform(folds).join(F.broadcast(coef), ["repeat", "fold"])
            .withColumn("prediction", F.col("__b") + dot).drop("__b", "__c"))
