"""The forest over counted rows: a tree against brute force over all rows, and the whole against MLlib's."""

from itertools import product

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from cohortlens.operators import forest as T

HOW = dict(numTrees=60, maxDepth=6, minInstancesPerNode=1, featureSubsetStrategy="sqrt", seed=7)


def brute(rows, depth, least, at=()):
    """Class shares by row of one tree over all rows and features, as {row index: shares}."""
    def sums(part):
        return [sum(w for _, y, w in (rows[i] for i in part) if y == k) for k in range(3)]

    def impurity(part):
        s = sums(part)
        return 1 - sum(v * v for v in s) / sum(s) ** 2

    def split(part, left):
        best = None
        if left and len({rows[i][1] for i in part}) > 1:
            whole = sum(sums(part))
            for f in range(3):
                v = sorted({r[0][f] for r in rows})
                for c in ((a + b) / 2 for a, b in zip(v, v[1:])):
                    sides = [i for i in part if rows[i][0][f] <= c], [i for i in part if rows[i][0][f] > c]
                    if min(map(len, sides)) >= least:
                        gain = impurity(part) - sum(sum(sums(s)) / whole * impurity(s) for s in sides)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = gain, sides
        if best is None:
            s = sums(part)
            return {i: [v / sum(s) for v in s] for i in part}
        return split(best[1][0], left - 1) | split(best[1][1], left - 1)

    return split(list(range(len(rows))), depth)


@pytest.mark.parametrize("depth,least", [(2, 1), (5, 8)])
def test_a_tree_over_counts_equals_one_over_all_rows(depth, least):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        x = (float(rng.integers(2)), float(rng.integers(4)), float(rng.integers(3)))
        y = int(np.clip(x[0] + x[1] - x[2] + rng.normal(), 0, 2))
        rows.append((x, y, [1.0, 0.5, 2.0][y]))
    groups = sorted(set(rows))
    n = np.array([rows.count(g) for g in groups])
    x, y, w = np.array([g[0] for g in groups]), np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
    edges = [T.cuts(x[:, f], n) for f in range(3)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    tree = T.grow(bins, edges, y, w, n, 3, depth, least, 3, np.random.default_rng(0))
    want = brute(rows, depth, least)
    assert T.votes([tree], np.array([r[0] for r in rows]), 3) == pytest.approx(np.array([want[i] for i in range(len(rows))]), abs=1e-9)


def frame(spark, copies):
    rows = [(Vectors.dense(a, b, c, d), float(k), 0.5 if k else 1.5, int(copies * (1 + a * (2 * k - 1) * 0.5 + b * k)))
            for a, b, c, d, k in product((0, 1), (0, 1, 2), (0, 1), (0, 1), (0, 1))]
    return spark.createDataFrame(rows, ["features", "label", "weight", "n"]).selectExpr("features", "label", "weight", "explode(sequence(1, n)) i").drop("i")


def test_many_rows_give_the_forest_of_mllib_without_it(spark, monkeypatch, tmp_path):
    df = frame(spark, 40).persist()
    monkeypatch.setattr(T, "ROWS", 1000)
    seen = []
    monkeypatch.setattr(T, "RandomForestClassifier", lambda **how: seen.append(how))
    model = T.ForestEstimator(2, **HOW).fit(df)
    assert not seen and len(model.trees()) == 60
    theirs = RandomForestClassifier(weightCol="weight", **HOW).fit(df)

    def shares(m):
        out = m.transform(df.distinct()).select("features", "label", vector_to_array("probability")[1].alias("p"), "prediction").collect()
        assert all(r.prediction == float(r.p > 0.5) or abs(r.p - 0.5) < 1e-9 for r in out)
        return {(str(r.features), r.label): r.p for r in out}

    ours = shares(model)
    assert max(abs(p - ours[k]) for k, p in shares(theirs).items()) < 0.08
    model.save(str(tmp_path / "m"))
    assert shares(T.ForestModel.load(str(tmp_path / "m"))) == ours
    assert shares(T.ForestEstimator(2, **HOW).fit(df.repartition(7))) == ours


@pytest.mark.parametrize("rows,groups", [(1 << 16, 1 << 14), (10, 20)])
def test_few_rows_and_rows_that_hardly_repeat_are_left_to_mllib(spark, monkeypatch, rows, groups):
    monkeypatch.setattr(T, "ROWS", rows)
    monkeypatch.setattr(T, "GROUPS", groups)
    model = T.ForestEstimator(2, **{**HOW, "numTrees": 3}).fit(frame(spark, 5))
    assert not isinstance(model, T.ForestModel) and model.getNumTrees == 3


def test_many_values_are_cut_into_bins_of_equal_weight():
    v = np.random.default_rng(3).normal(size=4000)
    edges = T.cuts(v, np.ones(4000))
    share = np.diff(np.concatenate([[0], np.searchsorted(np.sort(v), edges), [4000]])) / 4000
    assert len(edges) == T.BINS - 1 and share.max() < 0.04


def test_rows_that_mllib_refuses_are_refused(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS", 10)
    for x, y in ((float("nan"), 1.0), (1.0, -1.0)):
        df = spark.createDataFrame([(Vectors.dense(x), y, 1.0)] * 30, ["features", "label", "weight"])
        with pytest.raises(Exception, match="MUST"):
            T.ForestEstimator(2, **HOW).fit(df)
