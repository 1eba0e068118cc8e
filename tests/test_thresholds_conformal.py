import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import conformal as Q
from cohortlens.operators import metrics as M
from cohortlens.operators import thresholds as T


def _loop_recall(y, p, target, default):
    grid = np.unique(np.round(p, 4))
    best = default if default is not None else float(grid[0])
    for t in grid:
        pred = p >= t
        rec = (pred & (y == 1)).sum() / max(y.sum(), 1) if y.sum() else 0.0
        if rec >= target:
            best = float(t)
        else:
            break
    return best


def _loop_fbeta(y, p, beta):
    grid = np.unique(np.round(p, 4))
    best_t, best_v = 0.5, -1.0
    for t in grid:
        pred = p >= t
        tp = (pred & (y == 1)).sum()
        den = beta ** 2 * y.sum() + pred.sum()
        f = (1 + beta ** 2) * tp / den if den else 0.0
        if f > best_v:
            best_t, best_v = float(t), f
    return best_t


@pytest.mark.parametrize("seed", range(6))
def test_threshold_rules_match_loops(spark, seed):
    rng = np.random.default_rng(seed)
    n = 200
    y = rng.integers(0, 2, n)
    p = np.clip(0.4 * y + rng.normal(0.3, 0.2, n), 0, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    for target in (0.8, 1.0, 0.3):
        assert T.threshold_at_recall(df, "y", "p", target).first().threshold == pytest.approx(
            _loop_recall(y, p, target, 0.5), abs=0)
        assert T.threshold_at_recall(df, "y", "p", target, default=None).first().threshold == pytest.approx(
            _loop_recall(y, p, target, None), abs=0)
    assert T.threshold_fbeta(df, "y", "p", 2.0).first().threshold == _loop_fbeta(y, p, 2.0)
    st = T.optimise_threshold(df, "y", "p").first()
    assert st.recall >= 0.8


def test_group_thresholds_small_group_keeps_default(spark):
    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    p = np.clip(0.35 * y + rng.normal(0.3, 0.2, n), 0, 1)
    g = np.where(np.arange(n) < n - 5, np.where(np.arange(n) % 2 == 0, "a", "b"), "z")
    df = spark.createDataFrame([(int(a), float(b), str(c)) for a, b, c in zip(y, p, g)], "y int, p double, g string")
    cal = {r.grp: r for r in T.group_thresholds(df, "y", "p", "g", 0.8, 0.42).collect()}
    assert cal["z"].threshold == 0.42
    for k in ("a", "b"):
        assert cal[k].recall >= 0.8
    thr = T.group_thresholds(df, "y", "p", "g", 0.8, 0.42).select("grp", "threshold")
    unseen = spark.createDataFrame([(0.5, "unseen")], "p double, g string")
    m = T.apply_group_thresholds(unseen, "p", "g", thr, 0.42).first().mitigated
    assert m.threshold == 0.42 and m.at_risk is True


def test_conformal_quantile_reference_cases(spark):
    r = spark.createDataFrame([(float(i),) for i in range(1, 11)], "r double")
    assert Q.conformal_quantile(r, "r", 0.1).first().quantile == 10
    neg = r.select((-F.col("r")).alias("r"))
    assert Q.conformal_quantile(neg, "r", 0.5).first().quantile == 6
    assert Q.conformal_quantile(r, "r", 0.01).first().quantile == 10
    with pytest.raises(ValueError):
        Q.conformal_quantile(r, "r", 1.5)
    empty = spark.createDataFrame([], "r double")
    with pytest.raises(ValueError):
        Q.require_residuals(Q.conformal_quantile(empty, "r", 0.1))


def test_interval_bounds(spark):
    df = spark.createDataFrame([(3.0,), (50.0,), (98.0,)], "p double")
    lo, hi = M.interval_bounds(F.col("p"), 7.5, 0.0, 100.0)
    rows = df.select(lo.alias("lo"), hi.alias("hi")).orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in rows] == [(0.0, 10.5), (42.5, 57.5), (90.5, 100.0)]


def test_conformal_coverage_invariant(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 3))
    y = x @ np.array([3.0, -2.0, 1.0]) + rng.normal(0, 2, 1200)
    pred = x @ np.array([3.0, -2.0, 1.0])
    rows = [(float(a), float(b), i < 800) for i, (a, b) in enumerate(zip(y, pred))]
    df = spark.createDataFrame(rows, "y double, p double, cal boolean")
    cal = df.where("cal").select((F.col("y") - F.col("p")).alias("r"))
    q = Q.conformal_quantile(cal, "r", 0.1).first().quantile
    cov = M.interval_coverage(df.where("not cal"), "y", "p", q, 0.1, None, None).first()
    assert 0.86 <= cov.coverage <= 0.96 and cov.mean_width == pytest.approx(2 * q)
