"""Schema validation as one distributed pass (V1-V6).

All problems are gathered into a violations table ``(column_name, problem,
detail, n)``; :func:`assert_valid` raises one error listing every problem.
Counts come from a single ``agg`` (partial + final hash aggregation) and the
unknown categories from one ``groupBy`` over an unpivot of the categorical
columns, so the data is read once per part and never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.domain import ALLOWED, LIMITS

VIOLATION_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("problem", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("n", T.LongType()),
])

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class SchemaError(ValueError):
    """Raised when a DataFrame violates the declared rules."""


def _fmt(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def violations(df: DataFrame, allowed: Mapping[str, Sequence[str]] = ALLOWED,
               limits: Mapping[str, tuple[float, float]] = LIMITS, *, require_scores: bool = True) -> DataFrame:
    """V1-V6: the violations of ``allowed`` (column → values) and ``limits`` (column → smallest, largest value)."""
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    needed = [*allowed, *(limits if require_scores else ())]
    missing_rows = [(c, "missing_column", None, None) for c in needed if c not in types]

    # one wide aggregate of conditional counts
    counted: dict[tuple[str, str, str], Column] = {}
    for name in [c for c in (*allowed, *limits) if c in types]:
        floating = isinstance(types[name], (T.FloatType, T.DoubleType))
        counted[name, "missing_values", ""] = F.isnull(name) | (F.isnan(name) if floating else F.lit(False))
    for name in [c for c in limits if c in types]:
        if isinstance(types[name], _NUMERIC):
            low, high = limits[name]
            counted[name, "below_min", _fmt(low)] = F.col(name) < F.lit(low)
            counted[name, "above_max", _fmt(high)] = F.col(name) > F.lit(high)
        else:
            counted[name, "not_numeric", types[name].simpleString()] = (
                F.isnotnull(name) & F.isnull(F.expr(f"try_cast(`{name}` AS DOUBLE)")))
    aggs = [F.count_if(test).alias("|".join(key)) for key, test in counted.items()]
    parts = []
    if aggs:
        wide = df.agg(*aggs)
        long = wide.unpivot([], wide.columns, "key", "n")
        k = F.split(F.col("key"), r"\|")
        parts.append(long.where(F.col("n") > 0).select(
            k.getItem(0).alias("column_name"), k.getItem(1).alias("problem"),
            F.nullif(k.getItem(2), F.lit("")).alias("detail"), F.col("n").cast("long").alias("n")))

    cats = [c for c in allowed if c in types]
    if cats:
        bad = df.select([F.when(~F.col(c).isin(list(allowed[c])), F.col(c).cast("string")).alias(c) for c in cats])
        unk = (bad.unpivot([], cats, "column_name", "detail")
               .where(F.col("detail").isNotNull())
               .groupBy("column_name", "detail").count())
        parts.append(unk.select("column_name", F.lit("unknown_category").alias("problem"),
                                "detail", F.col("count").alias("n")))
    if missing_rows:
        parts.append(spark.createDataFrame(missing_rows, VIOLATION_SCHEMA))
    if not parts:
        return spark.createDataFrame([], VIOLATION_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assert_valid(df: DataFrame, allowed: Mapping[str, Sequence[str]] = ALLOWED,
                 limits: Mapping[str, tuple[float, float]] = LIMITS, *, require_scores: bool = True) -> DataFrame:
    """V1: raise :class:`SchemaError` naming every problem; return ``df`` unchanged.

    The message lists every unknown category, so the rows of the aggregated violations table
    come to the driver one partition at a time.
    """
    wording = {
        "missing_column": "missing column '{c}'", "missing_values": "column '{c}' has {n} missing values",
        "not_numeric": "column '{c}' must be numeric, got {d}", "below_min": "column '{c}' has values < {d}",
        "above_max": "column '{c}' has values > {d}"}
    problems: list[str] = []
    unknown: dict[str, list[str]] = {}
    for r in violations(df, allowed, limits, require_scores=require_scores).toLocalIterator():
        if r.problem == "unknown_category":
            unknown.setdefault(r.column_name, []).append(r.detail)
        else:
            problems.append(wording[r.problem].format(c=r.column_name, n=r.n, d=r.detail))
    problems += [f"column '{c}' has unknown categories {sorted(values)}" for c, values in unknown.items()]
    if problems:
        raise SchemaError("DataFrame failed schema validation:\n  - " + "\n  - ".join(sorted(problems)))
    return df
