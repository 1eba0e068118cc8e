"""Deterministic train/test split, stratified K-fold and fixed-size samples.

Rows are ordered by ``xxhash64(key, seed)`` (ties broken by the key) and
ranked within their stratum with the range-partitioned running count, so a
stratum holding a third of all rows is still ranked by many tasks. Each
stratum gets exactly ``rint(n_s · test_size)`` test rows; fold sizes inside a
stratum differ by at most one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.joins import join_dimension
from cohortlens.operators.ordered import running_totals


def _rank_within(df: DataFrame, key: str, strata: Sequence[str], seed: int) -> DataFrame:
    """Adds ``__rank`` (1-based) of each row within its stratum in hash order.

    Only the narrow ``(strata, key, hash)`` projection is ranked (and
    materialised); the rank joins back on the unique key, so wide rows are
    shuffled once and never written out.
    """
    s = list(strata)
    narrow = df.select(*s, key).withColumns({"__h": F.xxhash64(F.col(key), F.lit(seed)), "__one": F.lit(1)})
    ranked = running_totals(narrow, s, ["__h", key], ["__one"], prefix="__cum")
    return df.join(ranked.select(key, F.col("__cum__one").alias("__rank")), key)


def train_test_split(df: DataFrame, key: str, strata: Sequence[str] = (), test_size: float = 0.2,
                     seed: int = 42, part_col: str = "part") -> DataFrame:
    """L1: adds ``part`` = 'test' for the first rint(n_s · test_size) rows of each stratum."""
    s = list(strata)
    r = _rank_within(df, key, s, seed)
    n = df.groupBy(*s).agg(F.count(F.lit(1)).alias("__n"))
    r = join_dimension(r, n, s) if s else r.withColumn("__n", n.select("__n").scalar())
    k = F.rint(F.col("__n").cast("double") * F.lit(float(test_size)))
    return r.withColumn(part_col, F.when(F.col("__rank") <= k, "test").otherwise("train")).drop(
        "__rank", "__n")


def kfold(df: DataFrame, key: str, k: int = 5, strata: Sequence[str] = (), repeats: int = 1,
          seed: int = 42) -> DataFrame:
    """L2: (repeated) stratified K-fold → adds ``repeat`` and ``fold`` (one row per row and repeat)."""
    s = list(strata)
    parts = []
    for rep in range(repeats):
        r = _rank_within(df, key, s, seed + rep)
        parts.append(r.withColumns({"repeat": F.lit(rep), "fold": F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")})
                     .drop("__rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """L3: a fixed-size pseudo-random sample: the ``n`` rows with the smallest
    ``xxhash64(key, seed)``. Plans as TakeOrderedAndProject (each task keeps ``n``)."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def rank_by_metric(board: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Leaderboard rank 1..n by ``metric`` descending (boards are small: one row per candidate)."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col("model"))
    return board.withColumn("rank", F.row_number().over(w))


def split_sizes(split: DataFrame, strata: Sequence[str], part_col: str = "part") -> DataFrame:
    return split.groupBy(*strata, part_col).agg(F.count(F.lit(1)).alias("n"))
