"""Random forest classification (L9) over counted rows.

MLlib's forest keeps a count for each row and tree and walks every tree with every row once a level, which grows with rows x trees. A row
enters a tree only through its vector, label and weight, and how often it is drawn (Poisson with mean one a row and tree, as in
MLlib). The draws of n equal rows add up to one Poisson draw with mean n, so a tree over rows that are counted first has the same
law as one over the rows themselves. The rows are counted by one aggregation; where few groups are left (``GROUPS``), they go to
all tasks and each task grows whole trees. Tables of few rows, and those whose rows hardly repeat, are left to MLlib.

Trees split by Gini gain as MLlib's do: a subset of the features is drawn for each node, cuts lie between the values of a feature (up to
``BINS`` bins), and a leaf votes with its shares of the classes.
"""

from __future__ import annotations

import base64
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: distinct (vector, label, weight) up to which trees grow from their counts, and rows up to which MLlib grows them
GROUPS = 1 << 14
ROWS = 1 << 16
BINS = 32


def cuts(values: np.ndarray, weight: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Midpoints between all distinct ``values`` where these are at most ``bins``, else between bins of nearly equal weight."""
    v, at = np.unique(values, return_inverse=True)
    middle = (v[1:] + v[:-1]) / 2
    if len(v) <= bins:
        return middle
    below = np.cumsum(np.bincount(at, weight))
    return middle[np.unique(np.searchsorted(below[:-1], below[-1] * np.arange(1, bins) / bins).clip(0, len(middle) - 1))]


def subset_size(strategy: str, n: int) -> int:
    return {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}[strategy] if n else 0


def gini(sums: np.ndarray) -> np.ndarray:
    """Impurity of class ``sums`` (..., classes); empty ones have none."""
    total = sums.sum(axis=-1)
    return np.where(total > 0, 1.0 - (sums * sums).sum(axis=-1) / np.maximum(total * total, 1e-300), 0.0)


def grow(bins: np.ndarray, edges: list[np.ndarray], label: np.ndarray, weight: np.ndarray, drawn: np.ndarray, n_classes: int,
         max_depth: int, least: int, subset: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree over groups of equal rows, of which ``drawn`` rows each count: split feature (-1: leaf), threshold up to which rows
    go left, left child (the right one follows) and class shares by node."""
    w, n_features = weight * drawn, bins.shape[1]
    wide = max([len(e) + 1 for e in edges], default=1)
    feature, threshold, left, share = [-1], [0.0], [0], [np.bincount(label, w, n_classes)]
    node, open_nodes = np.zeros(len(w), np.int64), [0]
    for _ in range(max_depth):
        if not open_nodes:
            break
        place = np.full(len(feature), -1)
        place[open_nodes] = np.arange(len(open_nodes))
        slot = place[node]
        here = np.flatnonzero((slot >= 0) & (drawn > 0))
        slot, m = slot[here], len(open_nodes)
        shape = (m, wide, n_classes)
        best_gain, best_at = np.zeros(m), np.full((m, 2), -1)
        chosen = rng.random((m, n_features)).argsort(axis=1)[:, :subset]
        own = np.array([share[i] for i in open_nodes])
        for f in range(n_features):
            if not len(edges[f]):
                continue
            cell = slot * wide + bins[here, f]
            lo = np.bincount(cell * n_classes + label[here], w[here], m * wide * n_classes).reshape(shape).cumsum(axis=1)[:, :len(edges[f])]
            n = np.bincount(cell, drawn[here], m * wide).reshape(m, wide).cumsum(axis=1)
            n_lo, n_hi = n[:, :len(edges[f])], n[:, -1:] - n[:, :len(edges[f])]
            hi = np.maximum(own[:, None] - lo, 0.0)
            total = own.sum(axis=1)[:, None]
            gain = gini(own)[:, None] - (lo.sum(axis=2) * gini(lo) + hi.sum(axis=2) * gini(hi)) / total
            gain = np.where((n_lo >= least) & (n_hi >= least) & (chosen == f).any(axis=1)[:, None], gain, 0.0)
            top = gain.argmax(axis=1)
            value = gain[np.arange(m), top]
            better = value > np.maximum(best_gain, 1e-12)
            best_gain[better] = value[better]
            best_at[better] = np.stack([np.full(m, f), top], axis=1)[better]
        child = np.full(len(feature), -1)
        by = np.zeros((len(feature), 2), np.int64)
        for i, (f, cut) in zip(open_nodes, best_at):
            if f < 0:
                continue
            child[i], by[i] = len(feature), (f, cut)
            feature[i], threshold[i], left[i] = int(f), float(edges[f][cut]), len(feature)
            for column, x in ((feature, -1), (threshold, 0.0), (left, 0)):
                column.extend([x, x])
            share.extend([None, None])
        moved = np.flatnonzero(child[node] >= 0)
        at = node[moved]
        node[moved] = child[at] + (bins[moved, by[at, 0]] > by[at, 1])
        sums = np.bincount(node * n_classes + label, w, len(feature) * n_classes).reshape(-1, n_classes)
        open_nodes = []
        for i in child[child >= 0].tolist():
            for c in (i, i + 1):
                share[c] = sums[c]
                if np.count_nonzero(sums[c]) > 1:
                    open_nodes.append(c)
    sums = np.array(share)
    return {"feature": np.array(feature, np.int32), "threshold": np.array(threshold), "left": np.array(left, np.int32),
            "share": sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)}


def votes(trees: list[dict[str, np.ndarray]], x: np.ndarray, n_classes: int) -> np.ndarray:
    """Mean class shares of the leaves in which the rows of ``x`` end; equal rows are walked once."""
    if not len(x):
        return np.zeros((0, n_classes))
    x, back = np.unique(x, axis=0, return_inverse=True)
    own, out = np.arange(len(x)), np.zeros((len(x), n_classes))
    for t in trees:
        node = np.zeros(len(x), np.int64)
        while (inner := t["feature"][node] >= 0).any():
            right = x[own, t["feature"][node]] > t["threshold"][node]
            node = np.where(inner, t["left"][node] + right, node)
        out += t["share"][node]
    total = out.sum(axis=1, keepdims=True)
    return (out / np.where(total > 0, total, 1.0))[back.ravel()]


def _pack(trees: list[dict[str, np.ndarray]]) -> str:
    held = io.BytesIO()
    sizes = np.array([len(t["feature"]) for t in trees])
    np.savez_compressed(held, sizes=sizes, **{c: np.concatenate([t[c] for t in trees]) for c in trees[0]})
    return base64.b64encode(held.getvalue()).decode()


def _unpack(state: str) -> list[dict[str, np.ndarray]]:
    if not state:
        return []
    held = np.load(io.BytesIO(base64.b64decode(state)))
    columns = {c: held[c] for c in held.files}
    ends = np.cumsum(columns.pop("sizes"))[:-1]
    parts = {c: np.split(v, ends) for c, v in columns.items()}
    return [dict(zip(parts, t)) for t in zip(*parts.values())]


class ForestModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The grown trees; scores rows by one vectorised pandas UDF."""

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "input vector", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "the trees' arrays", TypeConverters.toString)

    def __init__(self, classes: int = 2, featuresCol: str = "features", state: str = ""):
        super().__init__()
        self._set(classes=classes, featuresCol=featuresCol, state=state)

    def trees(self) -> list[dict[str, np.ndarray]]:
        return _unpack(self.getOrDefault(self.state))

    def _transform(self, df: DataFrame) -> DataFrame:
        state, classes = self.getOrDefault(self.state), self.getOrDefault(self.classes)

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = _unpack(state)
            for x in batches:
                yield pd.Series(list(votes(trees, np.vstack(x.to_numpy()), classes)) if len(x) else [], dtype=object)

        out = df.withColumn("__voted", score(vector_to_array(self.getOrDefault(self.featuresCol))))
        best = (F.array_position("__voted", F.array_max("__voted")) - 1).cast("double")
        return out.withColumns({"probability": array_to_vector("__voted"), "prediction": best}).drop("__voted")


class ForestEstimator(Estimator):
    """Fits on all rows of ``featuresCol``, ``labelCol`` and ``weightCol``."""

    def __init__(self, n_classes: int, numTrees: int, maxDepth: int, minInstancesPerNode: int, featureSubsetStrategy: str, seed: int,
                 featuresCol: str = "features", labelCol: str = "label", weightCol: str = "weight"):
        super().__init__()
        self.n_classes, self.cols = n_classes, dict(featuresCol=featuresCol, labelCol=labelCol, weightCol=weightCol)
        self.how = dict(numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode,
                        featureSubsetStrategy=featureSubsetStrategy, seed=seed)

    def _fit(self, df: DataFrame):
        groups = self._counted(df)
        return RandomForestClassifier(**self.cols, **self.how).fit(df) if groups is None else self._grown(df, groups)

    def _counted(self, df: DataFrame) -> tuple[np.ndarray, ...] | None:
        """Distinct vectors, labels and weights, and how many rows there are of each, in one order; none if MLlib is to grow the trees or
        to refuse the rows (it takes no missing value and no unknown class)."""
        c = self.cols
        rows = df.select(vector_to_array(c["featuresCol"]).alias("x"), F.col(c["labelCol"]).cast("double").alias("y"),
                         F.col(c["weightCol"]).cast("double").alias("w"))
        if df.limit(ROWS + 1).count() <= ROWS:
            return None
        counted = rows.groupBy("x", "y", "w").agg(F.count(F.lit(1)).alias("n")).limit(GROUPS + 1)
        counted = counted.orderBy("x", "y", "w").toArrow()
        if counted.num_rows > GROUPS or any(counted[v].null_count for v in ("x", "y", "w")):
            return None
        x, y, w, n = (np.array(counted[v].to_pylist(), float) for v in ("x", "y", "w", "n"))
        known = np.isin(y, np.arange(self.n_classes)).all() and np.isfinite(x).all() and (np.isfinite(w) & (w >= 0)).all()
        return (x, y.astype(int), w, n) if known else None

    def _grown(self, df: DataFrame, groups: tuple[np.ndarray, ...]) -> ForestModel:
        spark, how, n_classes = df.sparkSession, self.how, self.n_classes
        x, label, weight, n = groups
        edges = [cuts(x[:, f], n) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        given = spark.sparkContext.broadcast((bins, edges, label, weight, n))
        subset = subset_size(how["featureSubsetStrategy"], x.shape[1])

        def run(batches: Iterator[pa.RecordBatch]):
            bins, edges, label, weight, n = given.value
            for b in batches:
                for i in b.column(0).to_pylist():
                    rng = np.random.default_rng([how["seed"], i])
                    tree = grow(bins, edges, label, weight, rng.poisson(n), n_classes, how["maxDepth"], how["minInstancesPerNode"], subset, rng)
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([_pack([tree])])], names=["id", "tree"])

        tasks = min(how["numTrees"], 2 * spark.sparkContext.defaultParallelism)
        grown = spark.range(0, how["numTrees"], 1, tasks).mapInArrow(run, "id long, tree string").toArrow().sort_by("id")
        given.unpersist()
        return ForestModel(n_classes, self.cols["featuresCol"], _pack([t for s in grown["tree"].to_pylist() for t in _unpack(s)]))
