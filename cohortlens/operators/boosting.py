"""Histogram gradient boosting (L10): quantile bins, second-order trees, binomial / multinomial / squared loss.

Spark form. A row enters a tree only through its binned feature vector, so the rows are first collapsed to distinct
binned vectors with their sums per class (weights, counts) or their label sums: exact, combined in the tasks before the
shuffle, and a vector that a third of all rows share becomes one row. Blocks of such vectors (bins, sums and raw scores as
packed arrays) are a Parquet table. One pass a level adds the newest trees to the raw scores, takes the gradients,
walks the trees under growth and sums gradient, hessian and count per (class, open node, feature, bin), features of few bins
together (``Bundle``); the sums are merged by a group-by whose result is bounded by classes x leaves x features x bins, and the driver picks
the splits from it. The trees of all classes grow in the same passes (true multinomial loss, not one against the rest). Each round's raw scores are
held by the executors and written anew every ``REFRESH`` rounds, so a pass applies no finished tree and a lost executor costs a reread and a few trees at most. Tables of up to ``IN_TASK`` distinct
vectors (a few MB) grow by the same steps inside one task, which saves a job for each level.

Trees grow by level; where a level would exceed ``max_leaf_nodes`` the splits with the largest gain stay.
Missing values (NaN) go to the last bin, hence to the right of every split.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage, release

MAX_BINS = 255
#: distinct binned vectors in a block, and blocks in a partition
BLOCK = 8192
BLOCKS = 16
REFRESH = 10
IN_TASK = 1 << 16
#: combinations of bins in a bundle of features
CODES = 4096
#: hessian that each side of a split needs at least
LEAST_HESSIAN = 1e-3


@dataclass
class Tree:
    """Arrays by node: split feature (-1: leaf), bin and value up to which rows go left, children, leaf value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float, values: tuple[float, float]) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.threshold[node] = feature, cut, threshold
        self.left[node], self.right[node] = first, first + 1
        for v in values:
            for column, x in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, v)):
                column.append(x)
        return first, first + 1

    def leaves(self, x: np.ndarray, by: str) -> np.ndarray:
        """The node in which each row of ``x`` (bins for ``cut``, values for ``threshold``) ends."""
        leaf, own = np.asarray(self.feature) < 0, np.arange(len(self.feature))  # a leaf leads to itself
        feature, bound = np.where(leaf, 0, self.feature), np.asarray(getattr(self, by))
        child = np.stack([np.where(leaf, own, self.right), np.where(leaf, own, self.left)], axis=1).ravel()
        level, depth = [0], 0
        while level := [c for n in level if self.feature[n] >= 0 for c in (self.left[n], self.right[n])]:
            depth += 1
        x = np.ascontiguousarray(x)
        flat, first, node = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = child.take(2 * node + (flat.take(first + feature.take(node)) <= bound.take(node)))
        return node

    def scores(self, x: np.ndarray, by: str) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(x, by)]


def added(raw: np.ndarray, rounds: list[list[Tree]], x: np.ndarray, by: str) -> np.ndarray:
    raw = raw.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            raw[:, k] += t.scores(x, by)
    return raw


def gradients(kind: str, raw: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the summed loss of each vector, one column for each tree of a round.

    ``sums``: weight per class (classification) or (weight, weighted label sum).
    """
    if kind == "regression":
        w = sums[:, :1]
        return w * raw - sums[:, 1:2], w + 0.0 * raw
    w = sums.sum(axis=1, keepdims=True)
    if kind == "binary":
        p = 1.0 / (1.0 + np.exp(-raw))
        return w * p - sums[:, 1:2], w * p * (1 - p)
    p = softmax(raw)
    wp = w * p
    return wp - sums, wp * (1 - p)


def softmax(raw: np.ndarray) -> np.ndarray:
    by_class = np.ascontiguousarray(raw.T)  # sums and maxima over a few long rows
    e = np.exp(by_class - by_class.max(axis=0))
    return np.ascontiguousarray((e / e.sum(axis=0)).T)


# --------------------------------------------------------------------------- bins and blocks

def bin_edges(x: DataFrame, n_features: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper edges of all but the last bin of each feature of ``x(x array<double>)``: midpoints of all distinct values where these
    are few, else of approximate quantiles."""
    long = x.select(F.posexplode("x").alias("i", "v")).filter(~F.isnan("v"))
    probs = [(i + 1) / (max_bins + 1) for i in range(max_bins)]
    found = {r["i"]: r for r in long.groupBy("i").agg(F.approx_count_distinct("v", 0.02).alias("n"), F.percentile_approx("v", probs, 20_000).alias("q")).collect()}
    few = [i for i, r in found.items() if r["n"] <= 0.9 * max_bins]
    values = {i: set(r["q"]) for i, r in found.items() if i not in few}
    for r in long.filter(F.col("i").isin(few)).distinct().toLocalIterator() if few else ():  # about max_bins values a feature at most
        values.setdefault(r["i"], set()).add(r["v"])
    out = []
    for i in range(n_features):
        v = np.array(sorted(values.get(i, ())), float)
        out.append((v[1:] + v[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


def bin_counts(edges: list[np.ndarray]) -> list[int]:
    return [len(e) + 1 for e in edges]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _bin_rows(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            m = binned(_matrix(b.column(0), len(edges)), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in m], pa.binary()), b.column(1), b.column(2)], names=["bins", "y", "w"])
    return run


def _pack(base: list[float]):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                n = part.num_rows
                sums = _matrix(part.column(1), len(part.column(1)[0])).astype(float)
                count = np.asarray(part.column(2), np.float64)
                raw = np.tile(np.asarray(base, float), (n, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), *[pa.array([v], pa.binary()) for v in
                     (b"".join(part.column(0).to_pylist()), sums.tobytes(), count.tobytes(), raw.tobytes())]], names=BLOCK_COLUMNS)
    return run


BLOCK_COLUMNS = ["n", "bins", "sums", "count", "raw"]
BLOCK_SCHEMA = "n int, bins binary, sums binary, count binary, raw binary"


def _blocks(batches: Iterator[pa.RecordBatch], rounds: list[list[Tree]]):
    """(bins, sums, count, raw with the trees of ``rounds``) of each block."""
    for b in batches:
        for row in b.to_pylist():
            n = row["n"]
            bins = np.frombuffer(row["bins"], np.uint8).reshape(n, -1)
            sums, raw = np.frombuffer(row["sums"]).reshape(n, -1), np.frombuffer(row["raw"]).reshape(n, -1)
            yield row, bins, sums, np.frombuffer(row["count"]), added(raw, rounds, bins, "cut")


def _refresh(rounds: list[list[Tree]]):
    def run(batches):
        for row, _, _, _, raw in _blocks(batches, rounds):
            yield pa.RecordBatch.from_pylist([row | {"raw": raw.tobytes()}], schema=pa.schema(
                [("n", pa.int32()), *[(c, pa.binary()) for c in BLOCK_COLUMNS[1:]]]))
    return run


HISTOGRAM = "k int, node int, f int, bin int, g double, h double, c double"


@dataclass
class Bundle:
    """Features whose bins together have at most ``CODES`` combinations: rows are summed by combination once, and the sums of each
    feature's bins follow from that."""

    features: list[int]
    sizes: list[int]

    def codes(self, columns: np.ndarray) -> np.ndarray:
        code = columns[self.features[0]].astype(np.int64)
        for f, size in zip(self.features[1:], self.sizes[1:]):
            code = code * size + columns[f]
        return code

    def indicator(self) -> np.ndarray:
        """(codes, all bins of the features): which bins a combination stands for."""
        after, code, out = int(np.prod(self.sizes)), np.arange(int(np.prod(self.sizes))), []
        for size in self.sizes:
            after //= size
            out.append(code[:, None] // after % size == np.arange(size))
        return np.hstack(out).astype(float)


def bundles(sizes: list[int]) -> list[Bundle]:
    """Features of ``sizes`` bins, dealt first-fit from the smallest on."""
    out: list[Bundle] = []
    for f in sorted(range(len(sizes)), key=lambda f: (sizes[f], f)):
        for b in out:
            if int(np.prod(b.sizes)) * sizes[f] <= CODES:
                b.features.append(f)
                b.sizes.append(sizes[f])
                break
        else:
            out.append(Bundle([f], [sizes[f]]))
    return out


class Histograms:
    """Sums by class (open nodes, features, bins, 3) over the blocks that are added, a size that the parameters set."""

    def __init__(self, growing: list[Tree], open_nodes: list[list[int]], sizes: list[int], dealt: list[Bundle]):
        self.growing, self.open_nodes, self.sizes, self.bundles = growing, open_nodes, sizes, dealt
        self.sums: dict[int, list[np.ndarray]] = {}

    def add(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, count: np.ndarray) -> None:
        columns = np.ascontiguousarray(bins.T)
        codes = [b.codes(columns) for b in self.bundles]
        for k, tree in enumerate(self.growing):
            nodes = len(self.open_nodes[k])
            if not nodes:
                continue
            place = np.full(len(tree.feature), -1)
            place[self.open_nodes[k]] = np.arange(nodes)
            slot = place[tree.leaves(bins, "cut")]
            here = np.flatnonzero(slot >= 0)
            every = len(here) == len(slot)
            slot = slot if every else slot[here]
            values = [np.ascontiguousarray(v if every else v[here]) for v in (g[:, k], h[:, k], count)]
            into = self.sums.setdefault(k, [np.zeros((3, nodes * int(np.prod(b.sizes)))) for b in self.bundles])
            for b, code, total in zip(self.bundles, codes, into):
                at = slot * int(np.prod(b.sizes)) + (code if every else code[here])
                for j, v in enumerate(values):
                    total[j] += np.bincount(at, v, total.shape[1])

    def by_feature(self) -> dict[int, np.ndarray]:
        out = {k: np.zeros((3, len(self.open_nodes[k]), len(self.sizes), MAX_BINS + 1)) for k in self.sums}
        for i, b in enumerate(self.bundles):
            to = b.indicator() if len(b.sizes) > 1 else None
            for k, totals in self.sums.items():
                values = totals[i].reshape(3, len(self.open_nodes[k]), -1)
                values = values if to is None else values @ to
                for f, size in zip(b.features, b.sizes):
                    out[k][:, :, f, :size], values = values[..., :size], values[..., size:]
        return {k: np.ascontiguousarray(np.moveaxis(v, 0, -1)) for k, v in out.items()}


def _histograms(kind: str, rounds: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]], sizes: list[int]):
    names = [c.split()[0] for c in HISTOGRAM.split(", ")]

    def run(batches):
        total, held = Histograms(growing, open_nodes, sizes, bundles(sizes)), []

        def add():
            bins, sums, count, raw = (np.concatenate([x[j] for x in held]) for j in range(4))
            total.add(bins, *gradients(kind, raw, sums), count)
            held.clear()

        for _, *block in _blocks(batches, rounds):
            held.append(block)
            if len(held) == BLOCKS:
                add()
        if held:
            add()
        for k, a in total.by_feature().items():
            node, f, b = np.nonzero(a[..., 2])
            v = a[node, f, b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), k), pa.int32()), pa.array(node, pa.int32()), pa.array(f, pa.int32()),
                 pa.array(b, pa.int32()), *[pa.array(v[:, j]) for j in range(3)]], names=names)
    return run


def merged_histograms(blocks: DataFrame, kind: str, rounds: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]], sizes: list[int]
                      ) -> dict[int, np.ndarray]:
    """One pass over ``blocks``; the merged sums are as large as one task's."""
    sums = blocks.mapInArrow(_histograms(kind, rounds, growing, open_nodes, sizes), HISTOGRAM)
    t = sums.groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("c").alias("c")).toArrow()
    k_, *at = (np.asarray(t[c]) for c in ("k", "node", "f", "bin"))
    values = np.stack([np.asarray(t[c]) for c in ("g", "h", "c")], axis=1)
    out = {}
    for k, nodes in enumerate(open_nodes):
        out[k] = np.zeros((len(nodes), len(sizes), MAX_BINS + 1, 3))
        mine = k_ == k
        out[k][tuple(a[mine] for a in at)] = values[mine]
    return out


# --------------------------------------------------------------------------- growth

@dataclass
class Growth:
    learning_rate: float = 0.1
    max_iter: int = 100
    max_leaf_nodes: int = 31
    min_samples_leaf: int = 20
    l2_regularization: float = 0.0


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    values: tuple[float, float]
    counts: tuple[float, float]


def best_split(hist: np.ndarray, n_edges: list[int], how: Growth) -> Split | None:
    """The split with the largest gain of a node's ``hist`` (features, bins, 3); ties go to the first feature and bin."""
    lam, best = how.l2_regularization, None
    for f, n in enumerate(n_edges):
        if not n:
            continue
        left = np.cumsum(hist[f], axis=0)[:n]
        all_ = hist[f].sum(axis=0)
        right = all_ - left
        ok = ((left[:, 2] >= how.min_samples_leaf) & (right[:, 2] >= how.min_samples_leaf)
              & (left[:, 1] >= LEAST_HESSIAN) & (right[:, 1] >= LEAST_HESSIAN))
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left[:, 0] ** 2 / (left[:, 1] + lam) + right[:, 0] ** 2 / (right[:, 1] + lam), -np.inf) - all_[0] ** 2 / (all_[1] + lam)
        top = float(gain.max())
        cut = int(np.flatnonzero(gain >= top - 1e-9 * abs(top))[0])
        if top > 1e-12 and (best is None or top > best.gain * (1 + 1e-9)):
            values = tuple(float(-how.learning_rate * s[cut, 0] / (s[cut, 1] + lam)) for s in (left, right))
            best = Split(top, f, cut, values, (float(left[cut, 2]), float(right[cut, 2])))
    return best


Sums = Callable[[list[Tree], list[list[int]]], dict[int, np.ndarray]]


def grow_round(sums: Sums, n_trees: int, edges: list[np.ndarray], how: Growth) -> list[Tree]:
    """One tree for each class; ``sums`` gives the histograms of the open nodes of the trees under growth."""
    trees = [Tree() for _ in range(n_trees)]
    open_nodes = [[0] for _ in trees]
    n_edges = [len(e) for e in edges]
    leaves = [1] * n_trees
    while any(open_nodes):
        hists = sums(trees, open_nodes)
        nxt: list[list[int]] = [[] for _ in trees]
        for k, tree in enumerate(trees):
            found = []
            for slot, node in enumerate(open_nodes[k]):
                hist = hists[k][slot] if k in hists else np.zeros((len(edges), MAX_BINS + 1, 3))
                if node == 0 and len(edges):
                    g, h, _ = hist[0].sum(axis=0)
                    tree.value[0] = float(-how.learning_rate * g / (h + how.l2_regularization)) if h + how.l2_regularization > 0 else 0.0
                split = best_split(hist, n_edges, how)
                if split:
                    found.append((split, node))
            for split, node in sorted(found, key=lambda s: (-s[0].gain, s[1])):
                if leaves[k] == how.max_leaf_nodes:
                    break
                children = tree.split(node, split.feature, split.cut, float(edges[split.feature][split.cut]), split.values)
                leaves[k] += 1
                nxt[k] += [c for c, n in zip(children, split.counts) if n >= 2 * how.min_samples_leaf]
            if leaves[k] == how.max_leaf_nodes:
                nxt[k] = []
        open_nodes = nxt
    return trees


def done(trees: list[Tree]) -> bool:
    """No class found a split."""
    return all(len(t.feature) == 1 for t in trees)


def as_json(base: list[float], rounds: list[list[Tree]]) -> str:
    return json.dumps({"base": base, "rounds": [[vars(t) for t in r] for r in rounds]})


def _grow_all(kind: str, base: list[float], edges: list[np.ndarray], how: Growth):
    """All rounds over the blocks of one task."""
    def run(batches):
        held = [x[1:] for x in _blocks(batches, [])]
        if not held:
            return
        bins, sums, count, raw = (np.concatenate([x[j] for x in held]) for j in range(4))
        rounds: list[list[Tree]] = []
        sizes = bin_counts(edges)
        for _ in range(how.max_iter):
            g, h = gradients(kind, raw, sums)

            def of(trees, open_nodes):
                total = Histograms(trees, open_nodes, sizes, [Bundle([f], [s]) for f, s in enumerate(sizes)])
                total.add(bins, g, h, count)
                return total.by_feature()

            rounds.append(grow_round(of, len(base), edges, how))
            raw = added(raw, rounds[-1:], bins, "cut")
            if done(rounds[-1]):
                break
        yield pa.RecordBatch.from_arrays([pa.array([as_json(base, rounds)])], names=["state"])
    return run


def _grow_by_passes(blocks: DataFrame, kind: str, base: list[float], edges: list[np.ndarray], how: Growth) -> str:
    """The same over blocks of any number, with one pass a level. A round's raw scores are held by the executors (in memory, else on
    their disks) and written anew every ``REFRESH`` rounds."""
    rounds: list[list[Tree]] = []
    written, held = blocks, blocks
    for i in range(how.max_iter):
        if i and i % REFRESH == 0:
            now = cut_lineage(held.mapInArrow(_refresh(rounds[-1:]), BLOCK_SCHEMA))
            release(written)
            written = now
        else:  # the round's first pass fills it
            now = (held.mapInArrow(_refresh(rounds[-1:]), BLOCK_SCHEMA) if i else held).persist(StorageLevel.MEMORY_AND_DISK)
        before, held = held, now
        first = True

        def sums(*a):
            nonlocal first
            found = merged_histograms(held, kind, [], *a, bin_counts(edges))
            if first and before is not held:
                before.unpersist()
            first = False
            return found

        rounds.append(grow_round(sums, len(base), edges, how))
        if done(rounds[-1]):
            break
    held.unpersist()
    release(written)
    return as_json(base, rounds)


class HistBoostingModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted rounds; scores rows by one vectorised pandas UDF."""

    kind = Param(Params._dummy(), "kind", "task kind", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "input vector", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "base scores and trees as JSON", TypeConverters.toString)

    def __init__(self, kind: str = "binary", featuresCol: str = "features", state: str = '{"base": [0.0], "rounds": []}'):
        super().__init__()
        self._set(kind=kind, featuresCol=featuresCol, state=state)

    def rounds(self) -> list[list[Tree]]:
        return [[Tree(**t) for t in r] for r in json.loads(self.getOrDefault(self.state))["rounds"]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        base = np.asarray(json.loads(self.getOrDefault(self.state))["base"], float)
        return added(np.tile(base, (len(x), 1)), self.rounds(), x, "threshold")

    def _transform(self, df: DataFrame) -> DataFrame:
        kind = self.getOrDefault(self.kind)
        base, rounds = np.asarray(json.loads(self.getOrDefault(self.state))["base"], float), self.rounds()

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.vstack(x.to_numpy())
            raw = added(np.tile(base, (len(m), 1)), rounds, m, "threshold")
            if kind == "binary":
                p = 1.0 / (1.0 + np.exp(-raw))
                raw = np.hstack([1 - p, p])
            elif kind == "multiclass":
                raw = softmax(raw)
            return pd.Series(list(raw))

        out = score(vector_to_array(self.getOrDefault(self.featuresCol)))
        if kind == "regression":
            return df.withColumn("prediction", out[0])
        best = (F.array_position("__boosted", F.array_max("__boosted")) - 1).cast("double")
        return df.withColumn("__boosted", out).withColumns({"probability": array_to_vector("__boosted"), "prediction": best}).drop("__boosted")


class HistBoostingEstimator(Estimator):
    """Fits on all rows of ``featuresCol``, ``labelCol`` and ``weightCol``."""

    def __init__(self, kind: str, n_classes: int = 2, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None,
                 max_bins: int = MAX_BINS, **how: Any):
        super().__init__()
        self.kind_, self.n_classes, self.cols, self.max_bins, self.how = kind, n_classes, (featuresCol, labelCol, weightCol), max_bins, Growth(**how)

    def base(self, sums: np.ndarray) -> list[float]:
        """Scores before the first tree, from the sums over all rows: log odds, log priors or the mean."""
        total = max(float(sums.sum()), 1e-300)
        if self.kind_ == "regression":
            return [float(sums[1] / sums[0]) if sums[0] else 0.0]
        p = np.clip(sums / total, 1e-12, 1.0)
        return [float(np.log(p[1] / p[0]))] if self.kind_ == "binary" else np.log(p).tolist()

    def _fit(self, df: DataFrame) -> HistBoostingModel:
        features, label, weight = self.cols
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
        one = rows.select(F.size("x").alias("n")).first()
        edges = bin_edges(rows, one["n"], self.max_bins) if one else []
        vectors = rows.mapInArrow(_bin_rows(edges), "bins binary, y double, w double").groupBy("bins")
        if self.kind_ == "regression":
            sums = F.array(F.sum("w"), F.sum(F.col("w") * F.col("y")))
        else:
            sums = F.array(*[F.coalesce(F.sum(F.when(F.col("y") == float(i), F.col("w"))), F.lit(0.0)) for i in range(self.n_classes)])
        table = cut_lineage(vectors.agg(sums.alias("sums"), F.count(F.lit(1)).cast("double").alias("count")))
        width = 2 if self.kind_ == "regression" else self.n_classes
        sizes = table.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).first()
        base = self.base(np.asarray([sizes[f"s{i}"] or 0.0 for i in range(width)]))
        parts = -(-sizes["n"] // (BLOCK * BLOCKS)) or 1
        if sizes["n"] <= IN_TASK:
            table_ = table.coalesce(parts)
        else:  # two tasks a core where there are blocks enough
            table_ = table.repartition(max(parts, min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-sizes["n"] // BLOCK))))
        blocks = cut_lineage(table_.mapInArrow(_pack(base), BLOCK_SCHEMA))
        release(table)
        if sizes["n"] <= IN_TASK:
            grown = blocks.coalesce(1).mapInArrow(_grow_all(self.kind_, base, edges, self.how), "state string").first()
            release(blocks)
            state = grown["state"] if grown else as_json(base, [])
        else:
            state = _grow_by_passes(blocks, self.kind_, base, edges, self.how)
        return HistBoostingModel(self.kind_, features, state)
