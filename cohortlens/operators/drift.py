"""Population drift: PSI per feature, KS on scores, report.

Both tables are tagged and unioned, features are unpivoted into long form,
and one ``groupBy(feature, bin)`` with conditional counts gives the share
table for every feature at once (no full outer join, no per-feature loop).
Numeric bins use exact reference quantiles (NumPy's linear rule), found with
the distributed order-statistic primitive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import expr as E
from cohortlens.functions.domain import DRIFT_MIN_ROWS, PSI_ALERT, PSI_EPS, PSI_WARN
from cohortlens.functions.stats import ks_pvalue_asymptotic
from cohortlens.operators.ordered import quantiles, running_totals, top_k_per_key

NULL_BIN = "__null__"
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _tagged(reference: DataFrame, current: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    # try_cast: values that are not numbers become null and are dropped
    r = reference.select(*[F.col(c).try_cast(cast).alias(c) for c in cols], F.lit(0).alias("__side"))
    c = current.select(*[F.col(c).try_cast(cast).alias(c) for c in cols], F.lit(1).alias("__side"))
    return r.unionByName(c).unpivot(["__side"], list(cols), "feature", "x")


def _psi_tail(cnt: DataFrame, counts: DataFrame) -> DataFrame:
    """(feature, bin…, n_ref, n_cur) → shares of the feature's sums over ``counts``, and contributions."""
    totals = counts.groupBy("feature").agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"))
    # one row per feature: bounded by the feature list, not by the data
    j = cnt.join(F.broadcast(totals), "feature")
    r = F.col("n_ref") / F.greatest(F.col("tot_ref"), F.lit(1.0)) + F.lit(PSI_EPS)
    c = F.col("n_cur") / F.greatest(F.col("tot_cur"), F.lit(1.0)) + F.lit(PSI_EPS)
    return j.withColumns({
        "reference": r - F.lit(PSI_EPS), "current": c - F.lit(PSI_EPS),
        "contribution": (c - r) * F.log(c / r)}).drop("n_ref", "n_cur", "tot_ref", "tot_cur")


def psi_categorical(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per (feature, bin): reference share, current share, contribution.

    Shares are over all rows (nulls form the ``__null__`` bin); categories
    seen on one side only get share 0 on the other.
    """
    long = _tagged(reference, current, features, "string").withColumn(
        "bin", F.coalesce(F.col("x"), F.lit(NULL_BIN)))
    side = F.col("__side")
    cnt = long.groupBy("feature", "bin").agg(
        F.count_if(side == 0).cast("double").alias("n_ref"),
        F.count_if(side == 1).cast("double").alias("n_cur"))
    return _psi_tail(cnt, cnt).withColumn("label", F.col("bin"))


PSI_PROBS = [float(v) for v in np.linspace(0, 1, 11)]


def _fmt0(x):
    """Python-style ``{:.0f}`` of a double (half-even; ±inf spelled out)."""
    return (F.when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .otherwise(F.format_string("%d", F.rint(x).cast("long"))))


def numeric_edges(reference: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """D2 edges per feature: distinct reference quantiles; outer edges → ±inf;
    a constant reference gives a single bin. Returns ``(feature, edges)``."""
    probs = [float(v) for v in np.linspace(0, 1, bins + 1)]
    long = reference.select(*[F.col(c).try_cast("double").alias(c) for c in features]).unpivot(
        [], list(features), "feature", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    q = quantiles(long, "x", probs, keys=["feature"], max_keys=len(features))
    e = q.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("value"))).alias("u"))
    # collect_list is bounded by bins + 1 values per feature
    inner = F.when(F.size("u") < 2, F.array().cast("array<double>")).otherwise(
        F.slice("u", 2, F.size("u") - 2))
    return e.select("feature", F.concat(F.array(F.lit(float("-inf"))), inner,
                                        F.array(F.lit(float("inf")))).alias("edges"))


def psi_numeric(reference: DataFrame, current: DataFrame, features: Sequence[str],
                bins: int = 10) -> DataFrame:
    """Per (feature, bin index): label "lo to hi", shares, contribution.

    Values that are not numbers are dropped on both sides (F3); shares use the
    non-null counts. Bin = number of inner edges <= x (left-closed bins).
    """
    # at most bins + 1 edges per feature: computed once and inlined as literals
    edge_rows = {r.feature: list(r.edges) for r in numeric_edges(reference, features, bins).collect()}
    long = _tagged(reference, current, features, "double").where(
        F.col("x").isNotNull() & ~F.isnan("x"))
    spark = reference.sparkSession
    lit_edges = F.create_map(*[x for f, e in edge_rows.items()
                               for x in (F.lit(f), F.array(*[F.lit(float(v)) for v in e]))])
    tagged = long.withColumn("edges", F.element_at(lit_edges, F.col("feature")))
    inner = F.slice("edges", 2, F.size("edges") - 2)
    b = F.size(F.filter(inner, lambda e: e <= F.col("x")))
    side = F.col("__side")
    cnt = tagged.groupBy("feature", b.alias("bin")).agg(
        F.count_if(side == 0).cast("double").alias("n_ref"),
        F.count_if(side == 1).cast("double").alias("n_cur"))
    # every bin of every feature, empty ones included (a literal table: bins per feature)
    grid_rows = [(f, i, e[i], e[i + 1]) for f, e in edge_rows.items() for i in range(len(e) - 1)]
    grid = spark.createDataFrame(grid_rows, "feature string, bin int, lo double, hi double")
    # cnt holds at most (bins + 1) rows per feature: a proven bound for the broadcast
    full = grid.join(F.broadcast(cnt), ["feature", "bin"], "left").select(
        "feature", "bin", F.concat(_fmt0(F.col("lo")), F.lit(" to "), _fmt0(F.col("hi"))).alias("label"),
        F.coalesce("n_ref", F.lit(0.0)).alias("n_ref"), F.coalesce("n_cur", F.lit(0.0)).alias("n_cur"))
    return _psi_tail(full, cnt).withColumn("bin", F.col("bin").cast("string"))


def psi_values(table: DataFrame) -> DataFrame:
    """(feature, psi, status) from a share table."""
    return table.groupBy("feature").agg(F.sum("contribution").alias("psi")).withColumn(
        "status", E.psi_status("psi"))


def feature_kinds(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> dict[str, str]:
    """D3: kind by the reference column type; features absent on either side are skipped."""
    rtypes = {f.name: f.dataType for f in reference.schema.fields}
    out = {}
    for f in features:
        if f in rtypes and f in current.columns:
            out[f] = "numeric" if isinstance(rtypes[f], _NUMERIC) else "categorical"
    return out


def share_tables(reference: DataFrame, current: DataFrame, features: Sequence[str],
                 bins: int = 10) -> DataFrame:
    """Share table of every usable feature: (feature, kind, bin, label, reference, current, contribution)."""
    kinds = feature_kinds(reference, current, features)
    cat = [f for f, k in kinds.items() if k == "categorical"]
    num = [f for f, k in kinds.items() if k == "numeric"]
    parts = []
    if cat:
        parts.append(psi_categorical(reference, current, cat).withColumn("kind", F.lit("categorical")))
    if num:
        parts.append(psi_numeric(reference, current, num, bins).withColumn("kind", F.lit("numeric")))
    if not parts:
        raise ValueError("no feature present on both sides")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("feature", "kind", "bin", "label", "reference", "current", "contribution")


def feature_drift(reference: DataFrame, current: DataFrame, features: Sequence[str],
                  bins: int = 10) -> DataFrame:
    """D3: (feature, kind, psi, status)."""
    t = share_tables(reference, current, features, bins)
    return t.groupBy("feature", "kind").agg(F.sum("contribution").alias("psi")).withColumn(
        "status", E.psi_status("psi"))


def top_shifts(shares: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` bins per feature that moved most (|shift| desc, then bin)."""
    s = shares.withColumn("shift", F.col("current") - F.col("reference"))
    return top_k_per_key(s, ["feature"], [F.abs(F.col("shift")).desc(), F.col("bin")], k).select(
        "feature", "rank", "bin", "label", "reference", "current", "shift")


def ks_statistic(reference: DataFrame, current: DataFrame, col: str,
                 ref_col: str | None = None) -> DataFrame:
    """Two-sample KS statistic D = max |F_ref − F_cur| with sample sizes and means.

    Counts per (value, side) → running totals in value order (range-partitioned,
    exact) → max gap. Returns one row (ks_statistic, n_reference, n_current,
    reference_mean, current_mean).
    """
    rc = ref_col or col
    r = reference.select(F.col(rc).cast("double").alias("v"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    c = current.select(F.col(col).cast("double").alias("v"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    u = r.unionByName(c).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = u.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tot = u.agg(F.struct(F.sum("a").alias("n1"), F.sum("b").alias("n2"),
                         F.sum(F.col("a") * F.col("v")).alias("s1"),
                         F.sum(F.col("b") * F.col("v")).alias("s2")).alias("t")).scalar()
    n1, n2 = tot["n1"], tot["n2"]
    cum = running_totals(counts, [], ["v"], ["a", "b"])
    # gap in a projection first: scalar subqueries may not sit inside aggregate arguments
    gaps = cum.select(F.abs(F.col("cum_a") / n1 - F.col("cum_b") / n2).alias("__gap"))
    d = gaps.agg(F.max("__gap").alias("ks_statistic"))
    return d.select("ks_statistic", n1.cast("long").alias("n_reference"), n2.cast("long").alias("n_current"),
                    (tot["s1"] / n1).alias("reference_mean"), (tot["s2"] / n2).alias("current_mean"))


@F.pandas_udf(T.DoubleType())
def _ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([ks_pvalue_asymptotic(float(a), int(b), int(c)) for a, b, c in zip(d, n1, n2)],
                     dtype="float64")


def score_drift(reference: DataFrame, current: DataFrame, col: str, ref_col: str | None = None,
                bins: int = 10) -> DataFrame:
    """Output drift — PSI (10 reference-quantile bins) + status + KS (+ asymptotic p) + means."""
    rc = ref_col or col
    ref = reference.select(F.col(rc).cast("double").alias("score"))
    cur = current.select(F.col(col).cast("double").alias("score"))
    psi = psi_values(psi_numeric(ref, cur, ["score"], bins)).select("psi", "status")
    ks = ks_statistic(ref, cur, "score")
    kss = ks.select(F.struct(*ks.columns)).scalar()  # one row, attached as a scalar subquery
    out = psi.withColumns({c: kss[c] for c in ks.columns})
    return out.withColumn("ks_pvalue", _ks_p("ks_statistic", "n_reference", "n_current"))


def drift_report(reference: DataFrame, current: DataFrame, features: Sequence[str], *,
                 reference_scores: DataFrame | None = None, current_scores: DataFrame | None = None,
                 score_col: str = "score", bins: int = 10,
                 min_rows: int = DRIFT_MIN_ROWS) -> dict[str, DataFrame]:
    """{'header', 'features', 'shifts', 'scores'}.

    The header row carries the overall status (alert > warn > ok, or
    ``insufficient`` when the current table has fewer than ``min_rows`` rows),
    counts and the PSI thresholds. Only the current row count is looked at on
    the driver, via a bounded check.
    """
    n_ref = reference.select(F.count(F.lit(1))).scalar()
    n_cur = current.select(F.count(F.lit(1))).scalar()
    enough = current.limit(min_rows).count() >= min_rows
    shares = share_tables(reference, current, features, bins)
    feats = shares.groupBy("feature", "kind").agg(F.sum("contribution").alias("psi")).withColumn(
        "status", E.psi_status("psi"))
    statuses = feats.select(E.status_rank("status").alias("r"))
    scores = None
    if reference_scores is not None and current_scores is not None:
        enough_scores = current_scores.limit(min_rows).count() >= min_rows
        if enough_scores:
            scores = score_drift(reference_scores, current_scores, score_col)
            statuses = statuses.unionByName(scores.select(E.status_rank("status").alias("r")))
    overall = E.rank_status(statuses.select(F.max("r")).scalar())
    spark = reference.sparkSession
    header = spark.range(1).select(
        (overall if enough else F.lit("insufficient")).alias("status"),
        n_ref.cast("long").alias("n_reference"), n_cur.cast("long").alias("n_current"),
        F.lit(min_rows).alias("min_rows"), F.lit(PSI_WARN).alias("warn"), F.lit(PSI_ALERT).alias("alert"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("computed_at"))
    return {"header": header, "features": feats if enough else feats.limit(0),
            "shifts": top_shifts(shares) if enough else top_shifts(shares).limit(0),
            "scores": scores}


def drift_display(report: dict[str, DataFrame]) -> DataFrame:
    """Feature rows plus a "(model output)" row, each with its largest shift."""
    feats = report["features"]
    top1 = report["shifts"].where(F.col("rank") == 1).select(
        "feature", F.col("label").alias("largest_shift_bin"), F.col("shift").alias("largest_shift"))
    rows = feats.join(top1, "feature", "left").select("feature", "psi", "status", "largest_shift_bin",
                                                      "largest_shift")
    if report.get("scores") is not None:
        s = report["scores"].select(F.lit("(model output)").alias("feature"), "psi", "status",
                                    F.lit(None).cast("string").alias("largest_shift_bin"),
                                    F.lit(None).cast("double").alias("largest_shift"))
        rows = rows.unionByName(s)
    return rows
