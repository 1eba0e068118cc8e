"""Ridge folds from one scan against a refit of every fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features as X
from cohortlens.operators import gram as G
from cohortlens.operators import training as TR
from cohortlens.operators.modeling import LABEL_COL, candidates
from cohortlens.operators.split import kfold
from cohortlens.sources import derived as D

SF = "/root/testdata/sf0.001"
RIDGE = {c.name: c for c in candidates("regression")}["ridge"]


@pytest.fixture(scope="module")
def folds(spark):
    task = X.TASKS["math_score"]
    eng = X.engineer(D.students(spark, SF)).limit(500)
    data = TR.prepare(task, eng.withColumn("lunch", F.when(F.col(TR.KEY) == eng.agg(F.min(TR.KEY)).first()[0], "rare").otherwise(F.col("lunch")))).persist()
    return task, data, kfold(data, TR.KEY, 4, [], 2, 7).persist()


@pytest.mark.parametrize("alpha", [1e-3, 1.0, 300.0])
def test_equals_refits(folds, alpha):
    """A category that one fold alone has, other scales in every training set, two repeats."""
    task, data, table = folds
    cfg, ctx = TR.TrainConfig(seed=7), TR._ctx(task, data, 7)
    one, _ = TR.cross_validate(task, table, RIDGE, {"alpha": alpha}, cfg, dict(ctx))
    many, _ = TR.refit_folds(task, table, RIDGE, {"alpha": alpha}, cfg, dict(ctx))
    a, b = ({(r["repeat"], r["fold"], r[TR.KEY]): r["prediction"] for r in o.collect()} for o in (one, many))
    assert a.keys() == b.keys() and len(a) == 2 * data.count()
    assert [a[k] for k in sorted(a)] == pytest.approx([b[k] for k in sorted(a)], rel=1e-6, abs=1e-6)


def test_one_scan_for_all_strengths(folds, monkeypatch):
    task, data, table = folds
    calls = []
    real = G.fold_gram
    monkeypatch.setattr(TR, "fold_gram", lambda *a: calls.append(1) or real(*a))
    cfg = TR.TrainConfig(seed=7, n_trials=5, cv_folds=3, parallelism=3)
    params, best, trials = TR.tune(task, data, RIDGE, cfg)
    rows = trials.collect()
    assert len(calls) == 1 and {r.state for r in rows} == {"COMPLETE", "PRUNED"}
    assert best == max(r.value for r in rows if r.state == "COMPLETE") and set(params) == {"alpha"}


def test_products_add_up(folds):
    task, data, table = folds
    g = G.fold_gram(table, list(task.inputs), LABEL_COL)
    n = data.count()
    for repeat in (0, 1):
        whole = sum(m for k, m in g.held_out.items() if k[0] == repeat)
        assert whole[0, 0] == n
        key = next(k for k in g.held_out if k[0] == repeat)
        assert g.training(key) + g.held_out[key] == pytest.approx(whole)
    y = data.agg(F.sum(LABEL_COL), F.sum(F.col(LABEL_COL) ** 2)).first()
    assert (whole[0, -1], whole[-1, -1]) == pytest.approx(tuple(y))


def test_constant_label_and_column():
    rng = np.random.default_rng(0)
    z = np.column_stack([np.ones(30), rng.normal(size=30), np.full(30, 4.0), np.full(30, 2.5)])
    assert G.ridge(z.T @ z, np.array([True, True]), 0.1)[0] == pytest.approx(2.5)
    z[:, 3] = 3 * z[:, 1] + 1
    b, c = G.ridge(z.T @ z, np.array([True, True]), 0.0)
    assert (b, *c) == pytest.approx((1.0, 3.0, 0.0), abs=1e-9)


def test_successive_halving(folds, monkeypatch):
    """40 trials: 20 go on after one fold, 10 after two, 5 after four; the pruned ones have the worst scores of their rung."""
    task, data, table = folds
    seen = []

    def fake(t, f, cand, params, cfg, ctx, only=None):
        seen.append((params["alpha"], len(only)))
        if params["alpha"] == 13:
            raise ValueError("no fit")
        return (params["alpha"], only), 0.0

    class Rows:
        def __init__(self, values):
            self.values = values

        def where(self, *_):
            return self

        select = where

        def collect(self):
            return [{"value": v} for v in self.values]

    monkeypatch.setattr(TR, "cross_validate", fake)
    monkeypatch.setattr(TR, "fold_metrics", lambda t, oof, keys: Rows([float(oof[0]) for _ in oof[1]]))
    numbers = iter(range(40))
    cand = TR.Candidate("c", "f", None, lambda r: {"alpha": next(numbers)})
    params, best, trials = TR.tune(task, data, cand, TR.TrainConfig(n_trials=40, cv_folds=5, seed=1))
    rows = {r.number: r for r in trials.collect()}
    assert [r.start for r in TR.rungs_of(5)] == [0, 1, 2, 4] and TR.rungs_of(1) == [range(0, 1)]
    assert (params, best) == ({"alpha": 39}, 39.0)
    assert rows[13].state == "FAIL: no fit" and rows[13].value is None
    assert sorted(i for i, r in rows.items() if r.state == "COMPLETE") == [35, 36, 37, 38, 39]
    assert all(rows[i].state == "PRUNED" and rows[i].value is None for i in range(35) if i != 13)
    assert [sum(1 for s in seen if s[1] == n) for n in (1, 2)] == [40 + 20 + 5, 10]
    assert TR.best_so_far(trials).count() == 5
