"""Join helpers with an explicit size check before broadcasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows, so the check stays cheap even when the
    answer is no.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def join_dimension(big: DataFrame, small: DataFrame, on: Column | str | list[str],
                   how: str = "inner", max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` to ``small``; broadcast ``small`` only if its row count is within ``max_rows``.

    Beyond the bound the join is left to the planner (shuffle / sort-merge,
    with AQE skew splitting), so a dimension that grows with the data never
    lands whole on every executor.
    """
    if row_count_at_most(small, max_rows):
        small = F.broadcast(small)
    return big.join(small, on, how)
