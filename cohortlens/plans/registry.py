"""Query registration: one Spark callable and (optionally) one oracle SQL per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.functions.expr import round_half_even

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column half-to-even on the scaled value (same rule as the SQL)."""
    exprs = {f.name: round_half_even(f.name, digits) for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(exprs) if exprs else df


def sql_round(col: str, digits: int = DIGITS) -> str:
    s = f"{float(10 ** digits)}"
    return f"round_even(CAST({col} AS DOUBLE) * {s}, 0) / {s}"


def rounded_sql(body: str, floats: Sequence[str]) -> str:
    if not floats:
        return body
    rep = ", ".join(f"{sql_round(c)} AS {c}" for c in floats)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS q"


def register(name: str, sql: str | None = None, floats: Sequence[str] = ()):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = rounded_sql(sql, floats)
        return run
    return deco
