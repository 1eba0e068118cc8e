"""Conformal prediction intervals.

The half-width is an exact order statistic of the absolute residuals: only the
value range that holds it is sorted, and no ``percentile`` buffer is kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ordered import kth_values
from cohortlens.session import cut_lineage


def conformal_quantile(df: DataFrame, residual: str, alpha: float,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Q1: k = ceil((n + 1)(1 - alpha)); k-th smallest |residual|; k > n → the maximum.

    Returns ``(keys, n, k, quantile)``. Raises for alpha outside (0, 1); keys
    with no residuals produce no row.
    """
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must be in (0, 1), got {alpha}")
    k = list(keys)
    a = F.abs(F.col(residual).cast("double"))
    v = cut_lineage(df.where(a.isNotNull() & ~F.isnan(a)).select(*k, a.alias("v")))
    nk = v.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where("n > 0").withColumn(
        "k", F.ceil((F.col("n") + 1).cast("double") * F.lit(1.0 - alpha)).cast("long"))
    rank = nk.select(*k, F.lit(0).alias("tid"), F.least("k", "n").alias("rank"))
    found = kth_values(v, "v", rank, k, materialize=False).select(*k, F.col("value").alias("quantile"))
    if k:
        return nk.join(found, k)
    return nk.withColumn("quantile", found.select("quantile").scalar())


def require_residuals(q: DataFrame) -> DataFrame:
    """Raise like the reference when there was nothing to calibrate on (a 1-row check)."""
    if q.limit(1).count() == 0:
        raise ValueError("Cannot calibrate on zero residuals")
    return q
