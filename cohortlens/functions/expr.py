"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.domain import PSI_ALERT, PSI_WARN, RISK_BANDS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: str | Column, digits: int) -> Column:
    """NumPy-style rounding: scale, round half to even, unscale (``np.round``)."""
    scale = float(10 ** digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` with ``default`` when the denominator is 0 or null (zero_division)."""
    q = F.try_divide(num, den)
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def flag(cond: Column) -> Column:
    """Boolean → 0/1 int, null counted as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def row_sum(cols: Sequence[str]) -> Column:
    """Sum skipping nulls; all-null rows give 0 (pandas ``sum(axis=1)``)."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))


def row_count(cols: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_mean(cols: Sequence[str]) -> Column:
    return F.try_divide(row_sum(cols), row_count(cols))


def row_std_samp(cols: Sequence[str]) -> Column:
    """Sample std (ddof 1) over the non-null values of a row; null when < 2 values."""
    m = row_mean(cols)
    ss = sum(
        (F.coalesce(F.pow(F.col(c) - m, F.lit(2.0)), F.lit(0.0)) for c in cols), F.lit(0.0)
    )
    k = row_count(cols)
    return F.when(k >= 2, F.sqrt(ss / (k - 1)))


def risk_band(p: str | Column) -> Column:
    x = col(p)
    # when-chain built inside-out, so the highest bound is tested first
    expr = F.lit(RISK_BANDS[0][1])
    for lo, name in RISK_BANDS[1:]:
        expr = F.when(x >= F.lit(lo), F.lit(name)).otherwise(expr)
    return expr


def psi_status(psi: str | Column) -> Column:
    x = col(psi)
    return F.when(x >= F.lit(PSI_ALERT), "alert").when(x >= F.lit(PSI_WARN), "warn").otherwise("ok")


def status_rank(s: str | Column) -> Column:
    x = col(s)
    return F.when(x == "alert", 2).when(x == "warn", 1).otherwise(0)


def rank_status(r: str | Column) -> Column:
    x = col(r)
    return F.when(x == 2, "alert").when(x == 1, "warn").otherwise("ok")


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    x = col(c)
    if lo is not None:
        x = F.greatest(F.lit(float(lo)), x)
    if hi is not None:
        x = F.least(F.lit(float(hi)), x)
    return x


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    """F-beta from counts, 0 on zero division (scikit-learn's count form)."""
    b2 = float(beta) ** 2
    num = F.lit(1.0 + b2) * tp
    den = F.lit(b2) * (tp + fn) + (tp + fp)
    return safe_div(num, den.cast("double"))
