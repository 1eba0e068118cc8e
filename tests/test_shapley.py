"""Shapley values: the coalition matrices, and sampled coalitions against enumeration on ten features."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from cohortlens.operators import attribution as AT
from cohortlens.operators import features as X

FEATS = tuple(f"f{i}" for i in range(10))
TASK = X.Task("y", FEATS, ["r2"])


def test_enumeration_is_the_mean_over_all_orders():
    rng = np.random.default_rng(0)
    masks, to = AT.all_coalitions(4)
    v = rng.normal(size=16)
    value = {tuple(m): x for m, x in zip(masks.tolist(), v)}
    want = np.zeros(4)
    for order in permutations(range(4)):
        has = [False] * 4
        for i in order:
            before = value[tuple(has)]
            has[i] = True
            want[i] += (value[tuple(has)] - before) / 24
    assert to @ v == pytest.approx(want)


def test_least_squares_over_all_subsets_is_enumeration():
    masks, to = AT.all_coalitions(6)
    some, by_squares = AT.sampled_coalitions(6, 62, 0)
    assert len(some) == 64
    at = {tuple(m): j for j, m in enumerate(masks.tolist())}
    v = np.random.default_rng(1).normal(size=64)
    assert by_squares @ v[[at[tuple(m)] for m in some.tolist()]] == pytest.approx(to @ v)


@pytest.mark.parametrize("n", [1, 2, 3, 12, 70])
def test_any_number_of_features_and_efficiency(n):
    masks, to = AT.coalitions(n, 200, 3)
    assert len(masks) <= max(2 ** min(n, 8), 200 + 2 * n + 2)
    slope = np.arange(1.0, n + 1)
    assert to @ (masks @ slope + 5) == pytest.approx(slope)  # additive values are met exactly
    curved = (masks @ slope) ** 2
    assert (to @ curved).sum() == pytest.approx(slope.sum() ** 2)


def model_of(formula):
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {formula} AS prediction FROM __THIS__")])


def frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, rng.normal(size=10))) for i in range(n)], ["key", *FEATS])


def values(sv):
    return {(r["key"], r["feature"]): r["shap_value"] for r in sv.collect()}


def test_sampled_values_near_enumeration_with_200_background_rows(spark):
    model = model_of("f0 * f1 + 2 * f2 - abs(f3) + f4 * f5 * f6 + 0 * f9")
    rows, bg = frame(spark, 4, 1), frame(spark, 200, 2)
    exact = values(AT.shapley_values(model, TASK, rows, bg, "key", budget=1024))
    near = values(AT.shapley_values(model, TASK, rows, bg, "key", budget=300, seed=4))
    assert len(exact) == len(near) == 40
    size = np.abs(list(exact.values())).max()
    assert max(abs(exact[k] - near[k]) for k in exact) < 0.05 * size
    base = model.transform(bg).agg(F.avg("prediction")).first()[0]
    for r in model.transform(rows).collect():
        for got in (exact, near):
            assert sum(v for (k, _), v in got.items() if k == r["key"]) == pytest.approx(r["prediction"] - base)
    assert max(abs(v) for (_, f), v in exact.items() if f == "f9") < 1e-9


def test_linear_model_and_null_features(spark):
    model = model_of("coalesce(f0, 9.0) + 3 * f1")
    rows = frame(spark, 3, 1).withColumn("f0", F.when(F.col("key") > 0, F.col("f0")))
    bg = frame(spark, 30, 2)
    mean = bg.agg(F.avg("f0").alias("a"), F.avg("f1").alias("b")).first()
    got = values(AT.shapley_values(model, TASK, rows.unionByName(rows), bg, "key"))
    for r in rows.collect():
        assert got[r["key"], "f0"] == pytest.approx((9.0 if r["f0"] is None else r["f0"]) - mean["a"])
        assert got[r["key"], "f1"] == pytest.approx(3 * (r["f1"] - mean["b"]))


def test_background_is_bounded(spark):
    with pytest.raises(ValueError, match="background"):
        AT.shapley_values(model_of("f0"), TASK, frame(spark, 2, 1), frame(spark, 1001, 2), "key")
    with pytest.raises(ValueError, match="background"):
        AT.shapley_values(model_of("f0"), TASK, frame(spark, 2, 1), frame(spark, 2, 2).limit(0), "key")
