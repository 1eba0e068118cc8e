import numpy as np
import pytest

from cohortlens.operators.ordered import quantiles, running_totals


@pytest.mark.parametrize("n_buckets", [1, 4, 64])
def test_running_totals_match_cumsum(spark, n_buckets):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, 400)
    vals = rng.integers(0, 50, 400).astype(float)
    rows = {}
    for k, v in zip(keys, vals):
        rows[(int(k), float(v))] = rows.get((int(k), float(v)), 0) + 1
    df = spark.createDataFrame([(k, v, c) for (k, v), c in rows.items()], "k int, v double, c long")
    got = {(r.k, r.v): r.cum_c for r in running_totals(df, ["k"], ["v"], ["c"], n_buckets=n_buckets).collect()}
    for (k, v), _ in rows.items():
        assert got[(k, v)] == sum(c for (kk, vv), c in rows.items() if kk == k and vv <= v)
    desc = {(r.k, r.v): r.cum_c for r in
            running_totals(df, ["k"], ["v"], ["c"], descending=True, n_buckets=n_buckets).collect()}
    for (k, v), _ in rows.items():
        assert desc[(k, v)] == sum(c for (kk, vv), c in rows.items() if kk == k and vv >= v)


def test_running_totals_global_and_empty(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(100)], "v double, c int")
    got = sorted((r.v, r.cum_c) for r in running_totals(df, [], ["v"], ["c"], n_buckets=8).collect())
    assert [c for _, c in got] == list(range(1, 101))
    empty = spark.createDataFrame([], "v double, c int")
    assert running_totals(empty, [], ["v"], ["c"]).count() == 0


@pytest.mark.parametrize("data", [
    list(np.random.default_rng(0).normal(50, 10, 501).round(1)),
    [5.0] * 20,
    [3.0],
    [1.0, 1.0, 2.0, 2.0, 2.0, 9.0],
])
def test_quantiles_match_numpy(spark, data):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    got = {r.prob: r.value for r in quantiles(df, "x", probs, n_buckets=8).collect()}
    want = np.quantile(np.array(data, dtype=float), probs)
    for p, w in zip(probs, want):
        assert got[p] == pytest.approx(w, abs=1e-12)
