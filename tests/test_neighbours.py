"""Exact k-NN by cells against brute force over all rows, at every size of cells, blocks and packs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from cohortlens.operators import neighbours as N


def brute(x, y, queries, k, kind, classes=2, weights="uniform"):
    out = []
    for q in queries:
        d = np.round(np.sqrt(((x - q) ** 2).sum(1)), 9)
        order = np.argsort(d, kind="stable")
        left, agg = min(k, len(x)), np.zeros(2 if kind == "regression" else classes)
        zero = d.min() == 0
        for v in np.unique(d[order]):
            if not left:
                break
            at = np.flatnonzero(d == v)
            share = min(left, len(at)) / len(at) * (1.0 if weights == "uniform" else float(v == 0) if zero else 1 / v)
            left -= min(left, len(at))
            for i in at:
                agg += share * (np.array([1.0, y[i]]) if kind == "regression" else np.eye(classes)[int(y[i])])
        out.append(agg[1] / agg[0] if kind == "regression" else agg / agg.sum())
    return np.array(out)


def rows_of(seed, n, width, grid):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * (1 + 3 * (rng.random((n, 1)) < 0.3))
    if grid:  # many ties and repeated vectors
        x = np.round(x)
    x[: n // 3] = x[0]  # one vector holds a third of all rows
    return x, rng.integers(0, 3, n).astype(float), np.vstack([x[::7], rng.normal(size=(40, width)) * 4])


def frame(spark, x, y=None):
    cols = ["i", "features"] + (["label"] if y is not None else [])
    return spark.createDataFrame([(i, Vectors.dense(v), *([float(y[i])] if y is not None else [])) for i, v in enumerate(x)], cols).repartition(3)


@pytest.mark.parametrize("grid", [True, False])
@pytest.mark.parametrize("kind,weights,k", [("multiclass", "uniform", 7), ("regression", "distance", 5), ("multiclass", "distance", 60)])
def test_equals_brute_force(spark, monkeypatch, grid, kind, weights, k):
    for name, value in (("CELL", 20), ("BLOCK", 8), ("PACK", 5)):
        monkeypatch.setattr(N, name, value)
    x, y, q = rows_of(1, 400, 3, grid)
    model = N.KNNEstimator(k, kind, 3, weights).fit(frame(spark, x, y))
    out = sorted(model.transform(frame(spark, q)).select("i", *([vector_to_array("probability").alias("p")] if kind != "regression" else []), "prediction").collect())
    want = brute(x, y, q, k, kind, 3, weights)
    if kind == "regression":
        assert [r.prediction for r in out] == pytest.approx(want, abs=1e-9)
    else:
        assert np.array([r.p for r in out]) == pytest.approx(want, abs=1e-9)


def test_all_labelled_rows_count_and_cells_are_pruned(spark, monkeypatch):
    """No bound on the rows; far cells are not visited."""
    monkeypatch.setattr(N, "CELL", 50)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 2)) * 100
    x = np.vstack([c + rng.normal(size=(150, 2)) for c in centre])
    y = np.repeat(np.arange(20) % 2, 150).astype(float)
    visits = []
    real = N.KNNModel._search
    monkeypatch.setattr(N.KNNModel, "_search", lambda self, v, w: visits.append(v.count()) or real(self, v, w))
    model = N.KNNEstimator(9, "binary", 2).fit(frame(spark, x, y))
    blocks = spark.read.parquet(model.getOrDefault("path"))
    assert blocks.agg({"total": "sum"}).first()[0] == len(x)
    q = x[::10]
    out = sorted(model.transform(frame(spark, q)).select("i", vector_to_array("probability").alias("p")).collect())
    assert np.array([r.p for r in out]) == pytest.approx(brute(x, y, q, 9, "binary"), abs=1e-9)
    assert visits[0] == len(q) and visits[1] < 0.3 * len(q) * 60  # of 60 cells each


def test_fewer_rows_than_neighbours_unlabelled_and_empty(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    model = N.KNNEstimator(10, "binary", 2).fit(frame(spark, x, [0.0, 1.0, -1.0]))  # the last has no known label
    out = model.transform(frame(spark, x)).select("prediction", vector_to_array("probability").alias("p")).collect()
    assert [list(r.p) for r in out] == [[0.5, 0.5]] * 3
    assert model.transform(frame(spark, x).limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        N.KNNEstimator(3).fit(frame(spark, x, [0.0] * 3).limit(0))


def test_saved_pipeline_carries_its_prototypes(spark, tmp_path):
    x, y, q = rows_of(2, 90, 2, True)
    model = Pipeline(stages=[N.KNNEstimator(5, "multiclass", 3)]).fit(frame(spark, x, y))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.stages[0].getOrDefault("path").startswith(str(tmp_path))
    a, b = (sorted(m.transform(frame(spark, q)).select("i", "prediction").collect()) for m in (model, again))
    assert a == b


def test_work_for_a_query_does_not_grow_with_the_rows(monkeypatch):
    """Eight times the prototypes on the same ground: distances taken for a query stay about the same, results are those of all pairs."""
    rng = np.random.default_rng(9)
    taken = []
    for n in (1000, 8000):
        x = np.hstack([rng.normal(size=(n, 2)), rng.integers(0, 2, (n, 2))])
        q, w, seen = x[:200], np.eye(2)[rng.integers(0, 2, n)], []
        real = N.distances
        with monkeypatch.context() as m:
            m.setattr(N, "distances", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
            at, d, rows = N.nearest(q, np.full(len(q), np.inf), x, w, w.sum(axis=1), 5)
        taken.append(sum(seen) / len(q))
        all_ = np.round(real(q, x), 9)
        for i in range(len(q)):
            assert d[at == i] == pytest.approx(np.unique(np.sort(all_[i])[:5]))
            assert rows[at == i].sum(axis=0) == pytest.approx(w[np.argsort(all_[i])[:5]].sum(axis=0))
    assert taken[1] < 1.5 * taken[0] and taken[1] < 0.25 * 8000
