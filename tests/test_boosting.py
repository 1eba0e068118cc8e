"""Histogram boosting against a row-by-row brute force, and its distributed parts."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cohortlens.operators import boosting as B

HOW = dict(learning_rate=0.3, max_iter=7, max_leaf_nodes=6, min_samples_leaf=5, l2_regularization=0.5)


def data(kind, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [float(rng.randrange(2)), float(rng.randrange(9)), round(rng.gauss(0, 1), 1), 3.0]
        z = x[0] * 2 - x[1] / 3 + math.sin(3 * x[2]) + rng.gauss(0, 0.5)
        y = {"regression": z, "binary": float(z > 0), "multiclass": float((z > -1.5) + (z > 0.5))}[kind]
        rows.append((x, y, rng.choice([0.5, 1.0, 2.5])))
    return rows


def derivative(kind, raw, y, w):
    if kind == "regression":
        return [(w * (raw[0] - y), w)]
    if kind == "binary":
        p = 1 / (1 + math.exp(-raw[0]))
        return [(w * (p - y), w * p * (1 - p))]
    e = [math.exp(r - max(raw)) for r in raw]
    p = [v / sum(e) for v in e]
    return [(w * (p[k] - (y == k)), w * p[k] * (1 - p[k])) for k in range(len(raw))]


def brute(kind, rows, classes):
    """Raw scores of every row; trees are kept as lists of (leaf rows)."""
    lam, rate = HOW["l2_regularization"], HOW["learning_rate"]
    w_of = [sum(w for _, y, w in rows if y == k) for k in range(classes)]
    total = sum(w for _, _, w in rows)
    base = ([sum(w * y for _, y, w in rows) / total] if kind == "regression" else [math.log(w_of[1] / w_of[0])] if kind == "binary"
            else [math.log(v / total) for v in w_of])
    raw = [list(base) for _ in rows]
    cuts = [sorted({(a + b) / 2 for a, b in zip(v, v[1:])}) for v in (sorted({x[f] for x, _, _ in rows}) for f in range(4))]
    for _ in range(HOW["max_iter"]):
        d = [derivative(kind, r, y, w) for r, (_, y, w) in zip(raw, rows)]
        new = [list(r) for r in raw]
        for k in range(len(base)):
            score = lambda part: sum(d[i][k][0] for i in part) ** 2 / (sum(d[i][k][1] for i in part) + lam)
            done, level, leaves = [], [list(range(len(rows)))], 1
            while level:
                found = []
                for at, part in enumerate(level):
                    best = None
                    for f in range(4):
                        for c in cuts[f]:
                            le, ri = [i for i in part if rows[i][0][f] <= c], [i for i in part if rows[i][0][f] > c]
                            if min(len(le), len(ri)) < HOW["min_samples_leaf"] or min(sum(d[i][k][1] for i in s) for s in (le, ri)) < 1e-3:
                                continue
                            gain = score(le) + score(ri) - score(part)
                            if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                                best = (gain, at, le, ri)
                    if best:
                        found.append(best)
                nxt, split = [], set()
                for _, at, le, ri in sorted(found, key=lambda s: -s[0]):
                    if leaves == HOW["max_leaf_nodes"]:
                        break
                    leaves += 1
                    split.add(at)
                    nxt += [le, ri]
                done += [p for at, p in enumerate(level) if at not in split]
                level = nxt if leaves < HOW["max_leaf_nodes"] else (done.extend(nxt) or [])
            for part in done:
                step = -rate * sum(d[i][k][0] for i in part) / (sum(d[i][k][1] for i in part) + lam)
                for i in part:
                    new[i][k] += step
        raw = new
    return raw


@pytest.mark.parametrize("in_task", [0, B.IN_TASK])
@pytest.mark.parametrize("kind,classes", [("binary", 2), ("regression", 1), ("multiclass", 3)])
def test_equals_brute_force(spark, monkeypatch, kind, classes, in_task):
    monkeypatch.setattr(B, "IN_TASK", in_task)  # by passes over all blocks, or in one task
    monkeypatch.setattr(B, "REFRESH", 3)  # raw scores are written anew in between
    monkeypatch.setattr(B, "BLOCK", 64)
    monkeypatch.setattr(B, "BLOCKS", 2)  # several partitions
    rows = data(kind)
    df = spark.createDataFrame([(Vectors.dense(x), y, w) for x, y, w in rows], ["features", "label", "weight"]).repartition(5)
    model = B.HistBoostingEstimator(kind, classes, weightCol="weight", **HOW).fit(df)
    got = model.raw(np.array([x for x, _, _ in rows]))
    assert got == pytest.approx(np.array(brute(kind, rows, classes)), abs=1e-6)
    out = model.transform(df)
    if kind == "regression":
        assert out.agg(F.corr("prediction", "label")).first()[0] > 0.8
    else:
        assert out.filter("prediction = label").count() > 0.75 * len(rows)


def test_persisted_model_and_missing_values(spark, tmp_path):
    rows = data("multiclass", 200)
    df = spark.createDataFrame([(Vectors.dense(x if i % 9 else [x[0], math.nan, x[2], x[3]]), y) for i, (x, y, _) in enumerate(rows)], ["features", "label"])
    model = B.HistBoostingEstimator("multiclass", 3, **HOW).fit(df)
    model.save(str(tmp_path / "m"))
    again = B.HistBoostingModel.load(str(tmp_path / "m"))
    a, b = (m.transform(df).select("probability", "prediction").collect() for m in (model, again))
    assert a == b and all(abs(sum(r.probability) - 1) < 1e-9 for r in a)


def test_one_row_a_vector_and_bounded_sums(spark):
    """A vector held by most rows is one row of the blocks, and weights repeat rows exactly."""
    rows = data("binary", 150)
    many = [(Vectors.dense(x), y, 1.0) for x, y, _ in rows for _ in range(3)] + [(Vectors.dense(rows[0][0]), 1.0, 1.0)] * 500
    once = [(Vectors.dense(x), y, 3.0) for x, y, _ in rows] + [(Vectors.dense(rows[0][0]), 1.0, 500.0)]
    how = {**HOW, "min_samples_leaf": 1}
    x = np.array([r[0] for r in rows])
    a, b = (B.HistBoostingEstimator("binary", weightCol="weight", **how).fit(spark.createDataFrame(r, ["features", "label", "weight"])).raw(x)
            for r in (many, once))
    assert a == pytest.approx(b, abs=1e-9)


def test_edges_of_few_and_many_values(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=5000)
    df = spark.createDataFrame([(([float(i % 3), float(v), 1.0]),) for i, v in enumerate(values)], "x array<double>")
    few, many, none = B.bin_edges(df, 3)
    assert few.tolist() == [0.5, 1.5] and len(none) == 0 and 200 < len(many) < 255
    share = np.diff(np.concatenate([[0], np.searchsorted(np.sort(values), many), [5000]])) / 5000
    assert share.max() < 0.02
    assert B.binned(np.array([[0.5, 9.0, np.nan]]), [few, many, none]).tolist() == [[0, len(many), 0]]


def test_empty_and_one_class(spark):
    schema = StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())])
    empty = spark.createDataFrame([], schema)
    for kind in ("binary", "regression", "multiclass"):
        assert B.HistBoostingEstimator(kind, 3 if kind == "multiclass" else 2, **HOW).fit(empty).transform(empty).count() == 0
    ones = spark.createDataFrame([(Vectors.dense([float(i)]), 1.0) for i in range(30)], schema)
    assert {r.prediction for r in B.HistBoostingEstimator("binary", **HOW).fit(ones).transform(ones).collect()} == {1.0}


def test_a_pass_applies_no_finished_tree(spark, monkeypatch):
    """The raw scores of a round are held, so the work of a pass does not depend on the rounds before."""
    monkeypatch.setattr(B, "IN_TASK", 0)
    seen, real = [], B.merged_histograms
    monkeypatch.setattr(B, "merged_histograms", lambda blocks, kind, rounds, *a: seen.append(len(rounds)) or real(blocks, kind, rounds, *a))
    rows = data("binary", 60)
    df = spark.createDataFrame([(Vectors.dense(x), y, w) for x, y, w in rows], ["features", "label", "weight"])
    B.HistBoostingEstimator("binary", weightCol="weight", **{**HOW, "max_iter": 3}).fit(df)
    assert len(seen) >= 3 and max(seen) == 0


def test_features_of_few_bins_are_summed_together():
    """Rows are added once a bundle, not once a feature, and give each feature's sums."""
    rng = np.random.default_rng(2)
    sizes = [2] * 11 + [1, 6, 68, 256]
    bins = np.stack([rng.integers(0, s, 3000) for s in sizes], axis=1).astype(np.uint8)
    g, h, count = rng.normal(size=(3000, 2)), rng.random((3000, 2)), rng.integers(1, 4, 3000).astype(float)
    dealt = B.bundles(sizes)
    assert len(dealt) <= 4 and sorted(f for b in dealt for f in b.features) == list(range(15))
    assert all(np.prod(b.sizes) <= B.CODES for b in dealt)
    tree = B.Tree()
    tree.split(0, 12, 2, 2.5, (0.0, 0.0))
    total = B.Histograms([tree, B.Tree()], [[2], [0]], sizes, dealt)
    for part in (slice(0, 1000), slice(1000, 3000)):
        total.add(bins[part], g[part], h[part], count[part])
    got = total.by_feature()
    for k, rows in ((0, bins[:, 12] > 2), (1, np.ones(3000, bool))):
        for f in range(15):
            for j, v in enumerate((g[:, k], h[:, k], count)):
                assert got[k][0, f, :, j] == pytest.approx(np.bincount(bins[rows, f], v[rows], B.MAX_BINS + 1), abs=1e-9)
