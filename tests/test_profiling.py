import numpy as np
import pytest

from cohortlens.operators import profiling as A


def test_histogram_matches_numpy_with_empty_bins(spark):
    vals = [0.0, 0.5, 1.0, 1.0, 7.5, 10.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = {r.bin: r.n for r in A.histogram(df, "x", bins=5).collect()}
    finite = np.array([v for v in vals if v == v])
    want = np.histogram(finite, bins=5, range=(finite.min(), finite.max()))[0]
    assert [got[i] for i in range(5)] == want.tolist()


def test_histogram_by_hue_keeps_every_bin_of_every_hue(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 9.0), ("b", 10.0), ("c", 5.0)]
    df = spark.createDataFrame(rows, "h string, x double")
    out = A.histogram(df, "x", bins=4, hue="h").collect()
    assert len(out) == 3 * 4
    for hue in "abc":
        xs = np.array([x for h, x in rows if h == hue])
        want = np.histogram(xs, bins=4, range=(1.0, 10.0))[0]
        got = sorted((r.bin, r.n) for r in out if r.h == hue)
        assert [n for _, n in got] == want.tolist()


def test_class_share_fixed_order_absent_and_unknown_levels(spark):
    df = spark.createDataFrame([("high",), ("high",), ("low",), ("other",)], "level_col string")
    out = A.class_share(df, "level_col", ("low", "medium", "high"), digits=3).collect()
    assert [(r.level, r.n) for r in out] == [("low", 1), ("medium", 0), ("high", 2)]
    # shares are over all rows, unknown levels included in the denominator
    assert [r.share for r in out] == pytest.approx([0.25, 0.0, 0.5])
