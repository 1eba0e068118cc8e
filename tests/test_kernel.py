"""Nyström features: exact on landmarks, closer with more of them, and a candidate of every kind."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import features as X
from cohortlens.operators import kernel as K
from cohortlens.operators.kernel import NystromEstimator, NystromModel, inverse_root, rbf
from cohortlens.operators.modeling import candidates, make_pipeline
from cohortlens.operators.training import prepare
from cohortlens.sources import derived as D

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(3).normal(size=(300, 4))
    return x, spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(np.vstack([x, x[:50]]))], ["i", "features"]).repartition(3).cache()


def kernel_error(model, x, df):
    phi = {r.i: r.k for r in model.transform(df).select("i", vector_to_array("kernel").alias("k")).collect()}
    phi = np.array([phi[i] for i in range(len(x))])
    return np.abs(phi @ phi.T - rbf(x, x, model.getOrDefault("gamma"))).mean()


def test_kernel_error_falls_to_zero(points):
    x, df = points
    errors = [kernel_error(NystromEstimator(m, 0.1, 1).fit(df), x, df) for m in (10, 60, 300)]
    assert errors[0] > 2 * errors[1] > 4 * errors[2] and errors[2] < 1e-6


def test_landmarks_do_not_depend_on_partitions_and_gamma_on_copies(points):
    x, df = points
    a, b = NystromEstimator(20, None, 5).fit(df), NystromEstimator(20, None, 5).fit(df.repartition(11))
    assert a.arrays()[0].tolist() == b.arrays()[0].tolist()
    every = np.vstack([x, x[:50]])
    assert a.getOrDefault("gamma") == pytest.approx(1 / (4 * every.var()))
    assert NystromEstimator(20, None, 6).fit(df).arrays()[0].tolist() != a.arrays()[0].tolist()


def test_repeated_directions_are_left_out():
    k = rbf(np.array([[0.0], [0.0], [1.0]]), np.array([[0.0], [0.0], [1.0]]), 1.0)
    root = inverse_root(k)
    assert root.shape == (3, 2) and (k @ root @ root.T @ k) == pytest.approx(k)


def test_saved_model_and_empty_input(points, spark, tmp_path):
    _, df = points
    model = NystromEstimator(15, 0.3).fit(df)
    model.save(str(tmp_path / "k"))
    again = NystromModel.load(str(tmp_path / "k"))
    assert again.transform(df).orderBy("i").first() == model.transform(df).orderBy("i").first()
    assert model.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        NystromEstimator().fit(df.limit(0))


@pytest.mark.parametrize("name", ["at_risk", "performance_level", "math_score"])
def test_candidate_of_every_kind(spark, name):
    task = X.TASKS[name]
    data = prepare(task, X.engineer(D.students(spark, SF)).limit(600)).persist()
    zoo = {c.family: c for c in candidates(task.kind, max(2, len(task.levels)))}
    model = make_pipeline(data, list(task.inputs), zoo["kernel"], {"n_components": 40}, {"n": 600.0, "y_std": 1.0, "seed": 2}).fit(data)
    out = model.transform(data)
    assert out.filter("prediction is null").count() == 0
    if task.levels:
        p = out.select(vector_to_array("probability").alias("p")).select(F.size("p").alias("n"), F.abs(F.expr("aggregate(p, 0d, (a, v) -> a + v)") - 1).alias("e"))
        assert p.agg(F.max("n"), F.max("e")).first()[0] == len(task.levels) or len(task.levels) == 2
    else:
        assert out.agg(F.var_pop(F.col("label") - F.col("prediction")) / F.var_pop("label")).first()[0] < 1.0


def test_many_rows_are_fitted_as_distinct_ones(spark, monkeypatch):
    """The logistic fit is given one row for each vector and label, with the weight of all its rows, and finds the same model."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (900, 3)).astype(float)
    y = (x.sum(axis=1) + rng.normal(size=900) > 3).astype(float)
    df = spark.createDataFrame([(Vectors.dense(v), k, 0.5 + k) for v, k in zip(x, y.tolist())], ["features", "label", "weight"]).repartition(3).persist()
    last = LogisticRegression(featuresCol="kernel", labelCol="label", weightCol="weight", regParam=0.05, standardization=False)
    given, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: given.append(rows.count()) or fit(self, rows))
    p = []
    for rows in (K.ROWS, 100):
        monkeypatch.setattr(K, "ROWS", rows)
        model = K.KernelLogistic(NystromEstimator(8, 0.5, 1), last).fit(df)
        p.append({str(r.features): r.p for r in model.transform(df).select("features", vector_to_array("probability")[1].alias("p")).distinct().collect()})
    assert given[0] == 900 and given[1] == len({(*v, k) for v, k in zip(x.tolist(), y.tolist())}) <= 54
    assert all(p[1][k] == pytest.approx(v, abs=1e-4) for k, v in p[0].items())
