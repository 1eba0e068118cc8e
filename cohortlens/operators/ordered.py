"""Ordered primitives without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
:func:`running_totals` instead:

1. splits the order column into value ranges at approximate quantiles
   (computed once, a bounded list of ``n_buckets`` numbers, inlined as
   literals so re-evaluation is deterministic);
2. runs the window per ``(keys, bucket)`` — one task per range;
3. adds each range's offset, taken from a table of per-range totals whose size
   is ``#keys × n_buckets`` no matter how large the input is.

The input must hold one row per ``(keys, order value)``; callers aggregate
counts per distinct value first (a partial + final hash aggregate), so even a
value holding a third of all rows becomes a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.joins import DEFAULT_BROADCAST_ROWS, join_dimension
from cohortlens.session import cut_lineage

_BUCKET = "__bucket"


def default_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(8, min(4096, 4 * parts))


def range_bounds(df: DataFrame, col: str, n_buckets: int) -> list[float]:
    """Sorted distinct inner bounds at approximate quantiles of ``col`` (≤ n_buckets - 1 values)."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    row = df.agg(F.approx_percentile(F.col(col).cast("double"), probs, 10_000).alias("b")).first()
    vals = row["b"] if row is not None and row["b"] is not None else []
    return sorted({float(v) for v in vals if v is not None and v == v})


def with_range_bucket(df: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """Bucket index of ``col`` against sorted ``bounds`` (binary search, JVM side)."""
    if not bounds:
        return df.withColumn(_BUCKET, F.lit(0.0))
    tmp = "__bucket_in"
    b = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=tmp,
                   outputCol=_BUCKET, handleInvalid="keep")
    return b.transform(df.withColumn(tmp, F.col(col).cast("double"))).drop(tmp)


def running_totals(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                   sum_cols: Sequence[str], *, descending: bool = False,
                   n_buckets: int | None = None, prefix: str = "cum_",
                   materialize: bool = True) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` within ``keys`` in order of ``order_cols``.

    ``order_cols[0]`` drives the range split; further order columns only break
    ties within equal values. Keys must be non-null.
    """
    keys = list(keys)
    n_buckets = default_buckets(df) if n_buckets is None else n_buckets
    if materialize:
        df = cut_lineage(df)  # read three times below: materialise once
    bounds = range_bounds(df, order_cols[0], n_buckets)
    b = with_range_bucket(df, order_cols[0], bounds)

    def _ord(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    w_local = (Window.partitionBy(*keys, _BUCKET).orderBy(*[_ord(c) for c in order_cols])
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = b.withColumns({f"__loc_{c}": F.sum(c).over(w_local) for c in sum_cols})

    totals = b.groupBy(*keys, _BUCKET).agg(*[F.sum(c).alias(f"__tot_{c}") for c in sum_cols])
    w_off = (Window.partitionBy(*keys).orderBy(_ord(_BUCKET))
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, _BUCKET, *[
        F.coalesce(F.sum(f"__tot_{c}").over(w_off), F.lit(0)).alias(f"__off_{c}") for c in sum_cols])
    if not keys:
        # one row per range, at most n_buckets rows: a proven bound
        offsets = F.broadcast(offsets)
    out = local.join(offsets, [*keys, _BUCKET])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"__off_{c}") + F.col(f"__loc_{c}")).alias(f"{prefix}{c}") for c in sum_cols])


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """NumPy's linear interpolation (uses the upper end when t ≥ 0.5)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def kth_values(values: DataFrame, value_col: str, targets: DataFrame, keys: Sequence[str] = (), *,
               n_buckets: int | None = None, materialize: bool = True,
               max_targets: int | None = None) -> DataFrame:
    """Exact order statistics: the value at 1-based ``rank`` for every target row.

    ``targets`` holds ``(keys..., tid, rank)``. Only the value ranges that
    contain a target rank are sorted: rows are counted per (keys, range) — a
    partial aggregate of ``#keys × n_buckets`` rows — the ranges holding the
    targets are picked from those counts, and a semi-join keeps just their
    rows for the final ordered count. The rest of the data is never shuffled
    by value. Returns ``(keys..., tid, value)``.

    ``max_targets`` is a bound on the number of target rows the caller can
    prove (for example features × ranks); the table of ranges holding a target
    is then broadcast without a size check.
    """
    keys = list(keys)
    n_buckets = default_buckets(values) if n_buckets is None else n_buckets
    x = F.col(value_col).cast("double")
    v = values.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("__v"))
    if materialize:
        v = cut_lineage(v)  # read by several branches below: materialise once
    b = with_range_bucket(v, "__v", range_bounds(v, "__v", n_buckets))
    bt = b.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("__bc"))
    wb = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bt = bt.withColumn("__bhi", F.sum("__bc").over(wb)).withColumn("__blo", F.col("__bhi") - F.col("__bc"))
    # target ranks → the range holding each (small × small: targets per key × ranges per key)
    tb = _attach_ranges(targets, bt, keys)
    tb = tb.where((F.col("__blo") < F.col("rank")) & (F.col("rank") <= F.col("__bhi"))).select(
        *keys, "tid", _BUCKET, (F.col("rank") - F.col("__blo")).alias("__lr"))
    wanted = tb.select(*keys, _BUCKET).distinct()
    # ranges holding a target: at most 2 per requested rank and key
    if not keys or (max_targets is not None and max_targets <= DEFAULT_BROADCAST_ROWS):
        # at most one range per target row: a proven bound
        sel = b.join(F.broadcast(wanted), [*keys, _BUCKET], "left_semi")
    else:
        sel = join_dimension(b, wanted, [*keys, _BUCKET], "left_semi")
    counts = sel.groupBy(*keys, _BUCKET, "__v").agg(F.count(F.lit(1)).alias("__c"))
    wl = Window.partitionBy(*keys, _BUCKET).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__lc", F.sum("__c").over(wl))
    hit = counts.join(tb, [*keys, _BUCKET]).where(
        (F.col("__lc") - F.col("__c") < F.col("__lr")) & (F.col("__lr") <= F.col("__lc")))
    return hit.select(*keys, "tid", F.col("__v").alias("value"))


def _attach_ranges(targets: DataFrame, bt: DataFrame, keys: list[str]) -> DataFrame:
    """Pair every target with the per-range counts of its key."""
    if keys:
        return targets.join(bt, keys)
    # no keys: the range table has at most n_buckets rows; attach it whole as one array
    arr = bt.select(F.collect_list(F.struct(_BUCKET, "__blo", "__bhi")).alias("a")).select("a").scalar()
    return targets.select("*", F.explode(arr).alias("__r")).select(
        *targets.columns, F.col(f"__r.{_BUCKET}").alias(_BUCKET), "__r.__blo", "__r.__bhi")


def quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
              keys: Sequence[str] = (), *, n_buckets: int | None = None,
              materialize: bool = True, max_keys: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key (W3 + W6; NumPy's default method).

    Returns ``(keys, prob, value)``. Nulls and NaN are ignored. Built on
    :func:`kth_values`, so nothing is held per group in memory (unlike
    ``percentile``) and only the value ranges around the requested ranks are sorted.
    ``max_keys`` is a bound on the number of keys known to the caller (e.g. a
    feature list), which spares a size check.
    """
    keys = list(keys)
    x = F.col(value_col).cast("double")
    v = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias(value_col))
    if materialize:
        v = cut_lineage(v)
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    targets = []
    for i, q in enumerate(probs):
        qv = F.lit(float(q))
        pos = F.col("__n").cast("double") * qv + (F.lit(1.0) - qv) - F.lit(1.0)
        fl = F.floor(pos)
        targets.append(F.struct(F.lit(i).alias("qi"), qv.alias("prob"), (pos - fl).alias("t"),
                                F.least(fl + 1, F.col("__n")).cast("long").alias("r1"),
                                F.least(fl + 2, F.col("__n")).cast("long").alias("r2")))
    tg = n.select(*keys, F.explode(F.array(*targets)).alias("g")).select(*keys, "g.*")
    ends = tg.select(*keys, F.explode(F.array(
        F.struct((F.col("qi") * 2).alias("tid"), F.col("r1").alias("rank")),
        F.struct((F.col("qi") * 2 + 1).alias("tid"), F.col("r2").alias("rank")))).alias("e")).select(
        *keys, "e.tid", "e.rank")
    bound = None if max_keys is None else 2 * len(probs) * max_keys
    kv = kth_values(v, value_col, ends, keys, n_buckets=n_buckets, materialize=False, max_targets=bound)
    a = kv.where(F.col("tid") % 2 == 0).select(*keys, (F.col("tid") / 2).cast("int").alias("qi"),
                                                F.col("value").alias("a"))
    b = kv.where(F.col("tid") % 2 == 1).select(*keys, ((F.col("tid") - 1) / 2).cast("int").alias("qi"),
                                                F.col("value").alias("b"))
    j = tg.join(a, [*keys, "qi"]).join(b, [*keys, "qi"])
    return j.select(*keys, "prob", _lerp(F.col("a"), F.col("b"), F.col("t")).alias("value"))


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank_col: str = "rank", salt: Sequence[str] = ()) -> DataFrame:
    """Top ``k`` rows per key.

    Small ``k`` plans as WindowGroupLimit: each map task keeps its local top ``k`` per key. Spark stops
    doing so above its threshold; with ``salt`` (columns that tell the rows of a key apart) a key is
    therefore ranked in parts first, and only each part's top ``k`` meet in the final rank.
    """
    part = "__part"
    if salt:
        n = default_buckets(df)
        parts = df.withColumn(part, F.pmod(F.xxhash64(*salt), F.lit(n)))
        w = Window.partitionBy(*keys, part).orderBy(*order)
        df = parts.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k).drop(rank_col, part)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
