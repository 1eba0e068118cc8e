"""Profiling: headline and group statistics, describe, correlation, tests.

Group-wise statistics over several attributes use one long-form aggregate:
``unpivot`` the attribute columns into ``(attribute, grp)`` and ``groupBy``
once. The expansion is map-side and the partial aggregate collapses it before
the shuffle, so a group holding a third of all rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import expr as E
from cohortlens.functions.domain import CATEGORICAL_COLUMNS, PERFORMANCE_LEVELS, SCORE_COLUMNS
from cohortlens.functions.stats import f_sf, t_two_sided_p
from cohortlens.operators.ordered import quantiles
from cohortlens.session import cut_lineage

GROUP_ATTRIBUTES = ("lunch", "test_preparation_course", "parental_level_of_education",
                    "race_ethnicity", "gender")


def long_attributes(df: DataFrame, attributes: Sequence[str], keep: Sequence[str],
                    attr_col: str = "attribute", group_col: str = "grp",
                    drop_null: bool = True) -> DataFrame:
    """Unpivot ``attributes`` (cast to string) into ``(attribute, grp)`` rows.

    Missing group values are dropped by default, as a pandas ``groupby`` does.
    """
    cast = df.select(*keep, *[F.col(a).cast("string").alias(a) for a in attributes])
    long = cast.unpivot(list(keep), list(attributes), attr_col, group_col)
    return long.where(F.col(group_col).isNotNull()) if drop_null else long


def headline_stats(eng: DataFrame) -> DataFrame:
    """A1: one row of headline statistics (one partial + final aggregate)."""
    n = F.count(F.lit(1))
    return eng.agg(
        n.alias("n_students"),
        F.avg("at_risk").alias("at_risk_rate"),
        F.avg("average_score").alias("average_score"),
        *[F.avg(c).alias(f"mean_{c}") for c in SCORE_COLUMNS],
        *[(F.count_if(F.col("performance_level") == lv) / n).alias(f"share_{lv}") for lv in PERFORMANCE_LEVELS],
    )


def group_stats(eng: DataFrame, attributes: Sequence[str] = GROUP_ATTRIBUTES) -> DataFrame:
    """Per (attribute, group): n, at-risk rate, mean average score."""
    long = long_attributes(eng, attributes, ["at_risk", "average_score"])
    return long.groupBy("attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("at_risk").alias("at_risk_rate"),
        F.avg("average_score").alias("avg_score"),
    )


def rate_by_group(eng: DataFrame, attributes: Sequence[str], rate_col: str = "at_risk") -> DataFrame:
    """Rate per group plus the overall rate (a scalar subquery), ordered by rate."""
    overall = eng.select(F.avg(rate_col)).scalar()
    long = long_attributes(eng, attributes, [rate_col])
    return (long.groupBy("attribute", "grp").agg(F.avg(rate_col).alias("rate"))
            .withColumn("overall_rate", overall)
            .orderBy("attribute", "rate", "grp"))


def group_summary(df: DataFrame, attribute: str, value_cols: Sequence[str]) -> DataFrame:
    """A3: size and means of ``value_cols`` for one attribute."""
    return df.groupBy(attribute).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in value_cols])


def describe(df: DataFrame, cols: Sequence[str] = SCORE_COLUMNS, digits: int = 2) -> DataFrame:
    """A4: count, mean, std (ddof 1), min, quartiles (linear), max per column, rounded."""
    long = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value").where(F.col("value").isNotNull()))
    basic = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, "value", [0.25, 0.5, 0.75], keys=["column_name"], materialize=False,
                  max_keys=len(cols))
    qw = q.groupBy("column_name").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    out = basic.join(qw, "column_name")
    r = lambda c: E.round_half_even(F.col(c), digits).alias(c)
    return out.select("column_name", F.col("count").cast("long").alias("count"),
                      r("mean"), r("std"), r("min"), r("p25"), r("p50"), r("p75"), r("max"))


def correlation(df: DataFrame, cols: Sequence[str] = SCORE_COLUMNS, digits: int = 3) -> DataFrame:
    """A5: Pearson matrix in long form ``(col_a, col_b, corr)``; all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]) if pairs else None
    parts = []
    if wide is not None:
        long = wide.unpivot([], wide.columns, "pair", "corr")
        k = F.split("pair", r"\|")
        upper = long.select(k.getItem(0).alias("col_a"), k.getItem(1).alias("col_b"), "corr")
        parts += [upper, upper.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")]
    spark = df.sparkSession
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "col_a string, col_b string, corr double")
    out = diag
    for p in parts:
        out = out.unionByName(p)
    return out.select("col_a", "col_b", E.round_half_even(F.col("corr"), digits).alias("corr"))


def category_counts(df: DataFrame, cols: Sequence[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Value counts per categorical column ``(column_name, category, n)``."""
    return (long_attributes(df, cols, [], "column_name", "category")
            .where(F.col("category").isNotNull())
            .groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("n")))


def class_share(df: DataFrame, col: str = "performance_level",
                classes: Sequence[str] = PERFORMANCE_LEVELS, digits: int = 3) -> DataFrame:
    """Count and share per class in a fixed class order (absent classes → 0)."""
    spark = df.sparkSession
    order = spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "class_order int, level string")
    # only listed classes can match: filtering first bounds the counts by len(classes)
    counts = (df.where(F.col(col).isin(list(classes)))
              .groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("n")))
    total = df.select(F.count(F.lit(1))).scalar()
    return (order.join(F.broadcast(counts), "level", "left")
            .select("class_order", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .withColumn("share", E.round_half_even(E.safe_div(F.col("n").cast("double"), total), digits))
            .orderBy("class_order"))


def table_shape(df: DataFrame) -> DataFrame:
    """A9 + A10: rows, columns, total missing values, duplicate rows (all but first)."""
    miss = sum((F.col(f.name).isNull().cast("long")
                + (F.isnan(f.name).cast("long") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(0))
                for f in df.schema.fields), F.lit(0))
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"), F.sum(miss).alias("__m"))
    return per_row.agg(
        F.sum("__c").cast("long").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.coalesce(F.sum("__m"), F.lit(0)).cast("long").alias("missing_values"),
        (F.sum("__c") - F.count(F.lit(1))).cast("long").alias("duplicates"),
    )


def _group_moments(df: DataFrame, attributes: Sequence[str], target: str) -> DataFrame:
    long = long_attributes(df, attributes, [target]).where(F.col(target).isNotNull())
    return long.groupBy("attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("m"),
        F.var_samp(target).alias("v"))


def attribute_tests(df: DataFrame, attributes: Sequence[str] = CATEGORICAL_COLUMNS,
                    target: str = "average_score", with_p: bool = False) -> DataFrame:
    """Welch t (two groups, first sorted group minus second) or one-way ANOVA F, and eta².

    Per-group (n, mean, var) come from one aggregate; the test statistic is
    a second aggregate over that small table. ``with_p`` adds p-values through
    a pandas UDF on the per-attribute rows.
    """
    g = _group_moments(df, attributes, target)
    per = g.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ssw"),
        # with exactly two groups these are the first and second in sorted order
        F.min_by(F.struct("n", "m", "v"), "grp").alias("g1"),
        F.max_by(F.struct("n", "m", "v"), "grp").alias("g2"))
    # two-pass between-group sum of squares (no cancellation); one row per group
    ssb = (g.join(F.broadcast(per.select("attribute", "grand")), "attribute")
           .groupBy("attribute").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))).alias("ssb")))
    g1, g2 = F.col("g1"), F.col("g2")
    se2 = g1["v"] / g1["n"] + g2["v"] / g2["n"]
    welch = (g1["m"] - g2["m"]) / F.sqrt(se2)
    welch_df = F.pow(se2, F.lit(2.0)) / (F.pow(g1["v"] / g1["n"], F.lit(2.0)) / (g1["n"] - 1)
                                        + F.pow(g2["v"] / g2["n"], F.lit(2.0)) / (g2["n"] - 1))
    out = per.join(ssb, "attribute").select(
        "attribute", "k", "n_total",
        F.when(F.col("k") == 2, "welch_t").otherwise("anova_f").alias("test"),
        F.when(F.col("k") == 2, welch).otherwise(
            F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n_total") - F.col("k")))
        ).alias("statistic"),
        F.when(F.col("k") == 2, welch_df).otherwise(F.lit(None).cast("double")).alias("df_welch"),
        F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw")))
         .otherwise(F.lit(0.0)).alias("eta_squared"),
    )
    if not with_p:
        return out.select("attribute", "test", "statistic", "eta_squared")

    @F.pandas_udf(T.DoubleType())
    def _p(test: pd.Series, stat: pd.Series, k: pd.Series, n: pd.Series, dfw: pd.Series) -> pd.Series:
        res = []
        for te, s, kk, nn, dw in zip(test, stat, k, n, dfw):
            if s is None or s != s:
                res.append(float("nan"))
            elif te == "welch_t":
                res.append(t_two_sided_p(float(s), float(dw)))
            else:
                res.append(f_sf(float(s), float(kk - 1), float(nn - kk)))
        return pd.Series(res, dtype="float64")

    return out.select("attribute", "test", "statistic",
                      _p("test", "statistic", "k", "n_total", "df_welch").alias("p_value"),
                      "eta_squared").orderBy(F.desc("eta_squared"))


def box_by_group(df: DataFrame, attributes: Sequence[str], target: str = "average_score") -> DataFrame:
    """(attribute, grp, n, min, q1, median, q3, max), ordered by median within attribute."""
    long = cut_lineage(long_attributes(df, attributes, [target]).where(F.col(target).isNotNull()))
    basic = long.groupBy("attribute", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.min(target).cast("double").alias("min"),
        F.max(target).cast("double").alias("max"))
    q = quantiles(long, target, [0.25, 0.5, 0.75], keys=["attribute", "grp"], materialize=False)
    qw = q.groupBy("attribute", "grp").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return (basic.join(qw, ["attribute", "grp"])
            .select("attribute", "grp", "n", "min", "q1", "median", "q3", "max")
            .orderBy("attribute", "median", "grp"))


def histogram(df: DataFrame, col: str, bins: int = 25, hue: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), empty bins kept.

    Bounds are scalar subqueries (computed once). Output
    ``(hue?, bin, bin_lo, bin_hi, n)``.
    """
    x = F.col(col).cast("double")
    data = df.where(x.isNotNull() & ~F.isnan(x))
    lo0 = data.select(F.min(x)).scalar()
    hi0 = data.select(F.max(x)).scalar()
    same = hi0 == lo0
    lo = F.when(same, lo0 - F.lit(0.5)).otherwise(lo0)
    hi = F.when(same, hi0 + F.lit(0.5)).otherwise(hi0)
    b = F.least(F.greatest(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(0)), F.lit(bins - 1))
    keys = [hue] if hue else []
    counts = data.withColumn("bin", b.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if hue:
        # every hue gets all bins: explode a fixed-length sequence, no join
        grid = data.select(F.col(hue)).distinct().select(
            hue, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, [*keys, "bin"], "left")
    width = (hi - lo) / F.lit(float(bins))
    return full.select(*keys, "bin", (lo + F.col("bin") * width).alias("bin_lo"),
                       (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                       F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k · n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def describe_all(df: DataFrame) -> DataFrame:
    """Per column count, unique, top (most frequent, ties → smallest) and freq."""
    long = long_attributes(df, df.columns, [], "column_name", "value").where(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    return vc.groupBy("column_name").agg(
        F.sum("c").cast("long").alias("count"),
        F.count(F.lit(1)).cast("long").alias("unique"),
        F.min_by(F.struct("value", "c"), F.struct(-F.col("c"), F.col("value"))).alias("__top"),
    ).select("column_name", "count", "unique", F.col("__top.value").alias("top"),
             F.col("__top.c").alias("freq"))


def fold_stats(scores: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and population std over folds."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def profile(eng: DataFrame, categorical: Sequence[str] = CATEGORICAL_COLUMNS,
            scores: Sequence[str] = SCORE_COLUMNS) -> dict[str, DataFrame]:
    """S8 content: every profile table of an engineered table (each one small)."""
    return {
        "shape": table_shape(eng),
        "describe": describe(eng, scores),
        "correlation": correlation(eng, scores),
        "categorical": category_counts(eng, categorical),
        "headline": headline_stats(eng),
        "level_share": class_share(eng),
        "tests": attribute_tests(eng, categorical, with_p=True),
    }


def write_profile(prof: dict[str, DataFrame], path: str) -> None:
    """S8 sink: one Parquet table per profile part, plus one JSON document of the parts.

    The document is built from the tables as written (a few rows each), so no part is computed twice.
    """
    spark = next(iter(prof.values())).sparkSession
    parts = []
    for name, df in prof.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        parts.append(rows.select(F.collect_list(F.to_json(F.struct("*")))).scalar().alias(name))
    doc = spark.range(1).select(F.to_json(F.struct(*parts)).alias("json"))
    doc.write.mode("overwrite").text(f"{path}/profile_json")


def group_rows(df: DataFrame, attribute: str) -> DataFrame:
    """The distinct sorted groups of a column."""
    return df.select(F.col(attribute).cast("string").alias("grp")).distinct().orderBy("grp")
