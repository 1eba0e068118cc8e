"""Permutation importance: equal rows are counted before they are scored, with the values of a row-by-row permutation."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens.operators import attribution as AT
from cohortlens.operators.features import Task


class Fixed(Transformer):
    """Scores two features and notes how many rows it is given."""

    def __init__(self, given):
        super().__init__()
        self.given = given

    def _transform(self, df):
        self.given.append(df.count())
        p = F.col("a") * 0.6 + F.col("b") * 0.1
        return df.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")})


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def macro_f1(y, p):
    return np.mean([2 * ((y == c) & (p == c)).sum() / max(1, (y == c).sum() + (p == c).sum()) for c in np.unique(np.concatenate([y, p]))])


@pytest.mark.parametrize("levels", [(0, 1), ("x", "y", "z")])
def test_counts_give_the_values_of_all_rows(spark, levels):
    rng = np.random.default_rng(3)
    n, repeats = 700, 3
    a, b = rng.integers(0, 2, n), rng.integers(0, 3, n)
    y = ((a + rng.random(n)) > 1).astype(float)
    df = spark.createDataFrame([(int(i), float(y[i]), float(a[i]), float(b[i])) for i in range(n)], ["id", "label", "a", "b"]).repartition(4)
    given = []
    got = {r["feature"]: r for r in AT.permutation_importance(PipelineModel([Fixed(given)]), Task("t", ("a", "b"), (), levels), df, "id", repeats, 42).collect()}
    assert max(given) <= 2 * repeats * 2 * 2 * 3  # not rows x repeats x features
    hashes = spark.range(n).select("id", *[F.xxhash64("id", F.lit(42) + F.lit(r)).alias(f"h{r}") for r in range(repeats)]).orderBy("id").toPandas()
    score = (lambda p: auc(y, p)) if len(levels) == 2 else (lambda p: macro_f1(y, (p > 0.5).astype(float)))
    for name in ("a", "b"):
        drops = []
        for r in range(repeats):
            order = np.argsort(hashes[f"h{r}"].to_numpy(), kind="stable")
            x = {"a": a, "b": b, name: (a if name == "a" else b)[order]}
            drops.append(score(a * 0.6 + b * 0.1) - score(x["a"] * 0.6 + x["b"] * 0.1))
        assert got[name].importance_mean == pytest.approx(np.mean(drops), abs=1e-9)
        assert got[name].importance_std == pytest.approx(np.std(drops), abs=1e-9)


def test_rows_are_paired_without_a_broadcast(spark, monkeypatch):
    """Both sides of the join hold every row once a repeat; the files they are read from are far smaller."""
    plans, auc_of = [], AT.M.roc_auc

    def noting(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return auc_of(df, *args, **kwargs)

    monkeypatch.setattr(AT.M, "roc_auc", noting)
    df = spark.range(200).selectExpr("id", "cast(id % 3 = 0 as double) label", "cast(id % 2 as double) a", "cast(id % 5 as double) b")
    AT.permutation_importance(PipelineModel([Fixed([])]), Task("t", ("a", "b"), (), (0, 1)), df, "id", 2, 42).collect()
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "__rk" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
