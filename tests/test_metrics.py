import numpy as np
import pytest

from cohortlens.operators import metrics as M


def _auc_brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    s = sum(((a > b) + 0.5 * (a == b)) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _ap_brute(y, p):
    ts = np.unique(p)[::-1]
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in ts:
        pred = p >= t
        tp = (pred & (y == 1)).sum()
        r, prec = tp / P, tp / pred.sum()
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(0.3 * y + rng.normal(0.35, 0.2, 300), 0, 1), 2)  # many ties
    g = rng.choice(["a", "b"], 300)
    df = spark.createDataFrame([(int(a), float(b), str(c)) for a, b, c in zip(y, p, g)], "y int, p double, g string")
    return df, y, p, g


def test_roc_auc_with_ties(spark, scored):
    df, y, p, g = scored
    assert M.roc_auc(df, "y", "p", n_buckets=8).first().roc_auc == pytest.approx(_auc_brute(y, p), abs=1e-12)
    by = {r.g: r.roc_auc for r in M.roc_auc(df, "y", "p", ["g"], n_buckets=4).collect()}
    for k in ("a", "b"):
        assert by[k] == pytest.approx(_auc_brute(y[g == k], p[g == k]), abs=1e-12)


def test_roc_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert M.roc_auc(df, "y", "p").first().roc_auc is None


def test_average_precision(spark, scored):
    df, y, p, _ = scored
    assert M.average_precision(df, "y", "p").first().average_precision == pytest.approx(_ap_brute(y, p), abs=1e-12)


def test_threshold_sweep_matches_loop(spark, scored):
    df, y, p, _ = scored
    rows = {round(r.threshold, 6): r for r in M.threshold_sweep(df, "y", "p").collect()}
    for t in np.linspace(0.05, 0.95, 91):
        pred = p >= t
        tp = (pred & (y == 1)).sum()
        prec = tp / pred.sum() if pred.sum() else 0.0
        rec = tp / y.sum()
        r = rows[round(float(t), 6)]
        assert r.precision == pytest.approx(prec) and r.recall == pytest.approx(rec)
        assert r.f1 == pytest.approx(2 * prec * rec / (prec + rec) if prec + rec else 0.0)


def test_regression_metrics(spark):
    y = np.array([10.0, 20.0, 0.5, 40.0])
    pr = np.array([12.0, 18.0, 1.0, 30.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, pr)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    sse = ((y - pr) ** 2).sum()
    assert r.r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum())
    assert r.rmse == pytest.approx(np.sqrt(sse / 4))
    assert r.mape == pytest.approx(np.mean(np.abs(y - pr) / np.clip(y, 1, None)) * 100)
    assert r.residual_std == pytest.approx(np.std(y - pr))


def test_class_report_and_confusion(spark):
    yt = [0, 0, 1, 1, 2, 2, 2]
    yp = [0, 1, 1, 1, 2, 0, 3]
    df = spark.createDataFrame(list(zip(yt, yp)), "y int, p int")
    rep = {r.label: r for r in M.class_report(df, "y", "p").collect()}
    assert rep["3"].support == 0 and rep["3"].precision == 0.0
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["1"].recall == 1.0
    assert rep["accuracy"].precision == pytest.approx(4 / 7)
    cm = {(r.y_true, r.y_pred): r.n for r in M.confusion_matrix(df, "y", "p").collect()}
    assert len(cm) == 16 and cm[(2, 3)] == 1 and cm[(3, 3)] == 0


def test_calibration_bins(spark, scored):
    df, y, p, _ = scored
    edges = np.percentile(p, np.linspace(0, 100, 11))
    ids = np.searchsorted(edges[1:-1], p)
    got = {r.bin: r for r in M.calibration_curve(df, "y", "p").collect()}
    for b in np.unique(ids):
        assert got[int(b)].n == (ids == b).sum()
        assert got[int(b)].prob_true == pytest.approx(y[ids == b].mean())
